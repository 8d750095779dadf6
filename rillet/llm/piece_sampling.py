"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text becomes a space symbol before each word. Where no piece has the two characters to either side of a place (the one
before a space symbol, most punctuation), the lattice falls apart into units; each distinct unit is filtered once per
worker (all new units of a batch together, position by position), and every occurrence is sampled backwards from its end:
at each place one of the pieces that end there is drawn in proportion to its forward weight. The uniform numbers are a
hash of the row key, the occurrence and the step, and a place's distribution is that of its unit alone, so a row's
segmentation is reproducible wherever, and with whatever other rows, it is computed.

A piece weighs exp(alpha * w), where w is the score of a unigram model, or -log(1 - score) for the ranks of a BPE model.
Characters without a piece are written as byte pieces; so is a literal space symbol, which keeps decoding lossless.

Defined results: null text counts as empty, which has no pieces and decodes to the empty text; rows with equal keys and
texts get equal pieces; a null key is a key like any other; an empty table gives an empty result; other columns are
kept by `encode`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Growing, Known, _sums, code_points, give_back, giving_back, groups_of, mix, powers, spread

SPACE = "▁"
BASE = 0xC2B2AE3D27D4EB4F
BYTE_WEIGHT = -10.0
#: Distinct units that a worker remembers; beyond that it forgets those met only once.
REMEMBERED = 1 << 17
#: Characters of text that are encoded together, or one text.
TOGETHER = 1 << 16
#: Smoothing: below 1, likely and unlikely segmentations come nearer.
ALPHA = 0.2
LITERAL = 0x110000  # stands for a space symbol that was in the text
_models: dict[tuple, PieceModel] = {}


def _hash(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(1))


class PieceModel:
    """The pieces of a model file, and the lattices of units met so far."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = [b""] * self.size
        normal = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                normal.append((i, piece, sp.get_score(i)))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"a piece spans words: {piece!r}")
        ranks = all(float(s).is_integer() and s <= 0 for _, _, s in normal)
        weight = (lambda s: -np.log(1 - s)) if ranks else (lambda s: s)
        # lookup by length: sorted hashes of whole pieces, and of beginnings of longer pieces
        self.longest = max(len(p) for _, p, _ in normal)
        self.whole, begin = {}, {n: [np.zeros(0, np.uint64)] for n in range(1, self.longest + 1)}
        self.joined = np.zeros(1 << 22, bool)  # by hash of two characters: whether a piece may have them side by side
        for n in range(1, self.longest + 1):
            same = [(p, i, alpha * weight(s)) for i, p, s in normal if len(p) == n]
            codes = np.frombuffer("".join(p for p, *_ in same).encode("utf-32-le"), np.uint32).reshape(-1, n)
            upto = np.cumsum(_hash(codes) * powers(BASE, n)[0], axis=1, dtype=np.uint64)
            order = np.argsort(upto[:, -1], kind="stable")
            self.whole[n] = (upto[order, -1], np.array([x[1] for x in same], np.int64)[order], np.array([x[2] for x in same], float)[order])
            for m in range(1, n):
                begin[m].append(upto[:, m - 1])
            self.joined[self._pairs(codes[:, :-1], codes[:, 1:])] = True
        self.begin = {n: np.unique(np.concatenate(x)) for n, x in begin.items()}
        self.byte_weight = alpha * BYTE_WEIGHT
        self.raw = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.n_bytes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.clear()

    @staticmethod
    def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (right.astype(np.uint32) * np.uint32(0x85EBCA6B))) >> np.uint32(10)

    def clear(self) -> None:
        self.known = Known(REMEMBERED)
        self.spelled: list[list[int]] = []  # byte pieces of characters without a piece
        self.spelled_of: dict[int, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.first_node, self.n_nodes = Growing(np.int64), Growing(np.int64)  # of each unit
        self.first_arc, self.n_arcs = Growing(np.int64), Growing(np.int64)  # of each node: the pieces that end there
        # of each arc: distribution function, piece, characters
        self.upto, self.piece, self.back = Growing(float), Growing(np.int32), Growing(np.int32)

    def _add(self, nodes: np.ndarray, arcs: np.ndarray, upto: np.ndarray, piece: np.ndarray, back: np.ndarray) -> None:
        """Units with their numbers of nodes, of arcs of each node, and the arcs."""
        self.first_node.add(self.n_arcs.n + np.cumsum(nodes) - nodes)
        self.n_nodes.add(nodes)
        self.first_arc.add(self.upto.n + np.cumsum(arcs) - arcs)
        self.n_arcs.add(arcs)
        self.upto.add(upto)
        self.piece.add(piece)
        self.back.add(back)

    def _forget(self, stay: np.ndarray) -> None:
        nodes = self.n_nodes.now[stay]
        each = spread(self.first_node.now[stay], nodes)
        arcs = self.n_arcs.now[each]
        at = spread(self.first_arc.now[each], arcs)
        held = self.upto.now[at], self.piece.now[at], self.back.now[at]
        self._empty()
        self._add(nodes, arcs, *held)

    def _spell(self, code: int) -> int:
        if code not in self.spelled_of:
            raw = (SPACE if code == LITERAL else chr(code)).encode()
            self.spelled_of[code] = len(self.spelled)
            self.spelled.append([int(self.byte_ids[b]) for b in raw])
        return self.size + self.spelled_of[code]

    def _learn(self, units: list[str]) -> None:
        """Filter new units forward and keep, for each place, the pieces that end there."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.array([len(u) for u in units])
        first = np.append(0, np.cumsum(length))
        codes = np.where(codes == ord(SPACE), LITERAL, np.where(codes == 32, ord(SPACE), codes))
        owner = np.repeat(np.arange(len(units)), length)
        left = first[1:][owner] - np.arange(len(codes))
        power, inverse = powers(BASE, len(codes) + 1)
        sums = _sums(_hash(codes) * power[:-1])
        alive, froms, tos, pieces, weights = np.arange(len(codes)), [], [], [], []
        for n in range(1, self.longest + 1):
            alive = alive[left[alive] >= n]
            if not len(alive):
                break
            key = (sums[alive + n] - sums[alive]) * inverse[alive]
            table, ids, w = self.whole[n]
            at = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
            hit = table[at] == key if len(table) else np.zeros(len(key), bool)
            froms.append(alive[hit])
            tos.append(alive[hit] + n)
            pieces.append(ids[at[hit]])
            weights.append(w[at[hit]])
            if n == 1:
                bare = np.flatnonzero(~hit)
                spelled = [self._spell(int(c)) for c in codes[alive[bare]]]
                froms.append(alive[bare])
                tos.append(alive[bare] + 1)
                pieces.append(np.array(spelled, np.int64))
                weights.append(np.array([self.byte_weight * len(self.spelled[s - self.size]) for s in spelled]))
            table = self.begin[n]
            alive = alive[table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key] if len(table) else alive[:0]
        source, target, piece, weight = (np.concatenate(x) for x in (froms, tos, pieces, weights))
        own = owner[source]
        depth, node_from, node_to = target - first[own], source + own, target + own  # a unit of n characters has n + 1 nodes
        order = np.argsort(depth * (len(codes) + len(units)) + node_to, kind="stable")
        forward = np.zeros(len(codes) + len(units))
        bounds = np.searchsorted(depth[order], np.arange(1, length.max() + 2))
        for d in range(len(bounds) - 1):
            now = order[bounds[d] : bounds[d + 1]]
            ends, at = np.unique(node_to[now], return_index=True)
            value = forward[node_from[now]] + weight[now]
            top = np.maximum.reduceat(value, at)
            counts = np.diff(np.append(at, len(now)))
            forward[ends] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), at))
        p = np.exp(forward[node_from] + weight - forward[node_to])
        order = np.argsort(node_to, kind="stable")  # the pieces that end at a node in order of length
        node_from, node_to, piece, p = node_from[order], node_to[order], piece[order], p[order]
        arcs = np.bincount(node_to, minlength=len(forward))
        rank = np.arange(len(p)) - np.repeat(np.cumsum(arcs) - arcs, arcs)
        upto = p.copy()
        for r in range(1, int(rank.max()) + 1):
            those = np.flatnonzero(rank == r)
            upto[those] += upto[those - 1]
        upto[np.cumsum(arcs)[arcs > 0] - 1] = 1.0
        self._add(length + 1, arcs, np.minimum(upto, 1.0), piece.astype(np.int32), (node_to - node_from).astype(np.int32))

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of all texts one after the other, and where each text's begin (n + 1); keys are 64-bit hashes of the rows' keys."""
        joined, codes, offsets = code_points([" " + t if t else "" for t in texts])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        shown = np.where(codes == ord(SPACE), LITERAL, np.where(codes == 32, ord(SPACE), codes))
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.joined[self._pairs(shown[:-1], shown[1:])]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        unit = self.known.find(joined, codes, starts, np.append(starts[1:], len(codes)), self._learn, self._forget)
        row = np.searchsorted(offsets, starts, "right") - 1
        in_row = np.arange(len(unit)) - np.searchsorted(row, np.arange(len(texts)))[row]
        seed = mix(keys[row] + mix(in_row.astype(np.uint64) + np.uint64(1)))
        stop = self.first_node.now[unit]
        node, who, step = stop + self.n_nodes.now[unit] - 1, np.arange(len(unit)), 0
        whose, steps, drawn = [], [], []
        going = node > stop
        while True:
            if not going.all():
                node, stop, who, seed = node[going], stop[going], who[going], seed[going]
            if not len(node):
                break
            u = (mix(seed + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12)).astype(float) / float(1 << 52)
            arc = self.first_arc.now[node]
            on = np.flatnonzero(self.upto.now[arc] <= u)
            while len(on):  # the last arc of a node has 1, so none goes on to the next node's
                arc[on] += 1
                on = on[self.upto.now[arc[on]] <= u[on]]
            drawn.append(self.piece.now[arc])
            whose.append(who)
            steps.append(np.full(len(who), step))
            node = node - self.back.now[arc]
            going = node > stop
            step += 1
        whose, steps, drawn = np.concatenate(whose), np.concatenate(steps), np.concatenate(drawn)
        many = np.bincount(whose, minlength=len(unit))
        offset = np.append(0, np.cumsum(many))
        out = np.zeros(offset[-1], np.int32)
        out[offset[whose] + many[whose] - 1 - steps] = drawn
        rows = np.repeat(row, many)
        if (out >= self.size).any():
            spelled = np.array([len(s) for s in self.spelled])
            times = np.where(out >= self.size, spelled[np.maximum(out - self.size, 0)], 1)
            flat = np.concatenate([np.array(s, np.int32) for s in self.spelled])
            start = np.append(0, np.cumsum(spelled))[:-1]
            at = np.repeat(out, times)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            out = np.where(at >= self.size, flat[np.minimum(start[np.maximum(at - self.size, 0)] + inner, len(flat) - 1)], at).astype(np.int32)
            rows = np.repeat(rows, times)
        return out, np.searchsorted(rows, np.arange(len(texts) + 1))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of pieces in UTF-8, with the space before it."""
        return self.raw[spread(self.first_byte[ids], self.n_bytes[ids])].tobytes()


def model(path: str, alpha: float = ALPHA) -> PieceModel:
    if (path, alpha) not in _models:
        _models[path, alpha] = PieceModel(path, alpha)
    return _models[path, alpha]


def _run(path: str, alpha: float, digest: bool):
    @giving_back
    def run(batches):
        pieces = model(path, alpha)
        for batch in batches:
            seeds = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (low, high) in enumerate(groups_of(pc.utf8_length(batch.column("text")).fill_null(0).to_pylist(), TOGETHER)):
                if k % 16 == 15:
                    give_back()
                texts = [t or "" for t in batch.column("text").slice(low, high - low).to_pylist()]
                row = batch.column("row").slice(low, high - low)
                ids, offsets = pieces.sample(texts, seeds[low:high])
                n = pa.array(np.diff(offsets), pa.int32())
                if not digest:
                    yield pa.RecordBatch.from_arrays([row, n, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["row", "n_pieces", "pieces"])
                    continue
                same, crc = [], []
                raw, decoded = memoryview(ids.astype("<u4").tobytes()), memoryview(pieces.decode(ids))
                bytes_to = np.append(0, np.cumsum(pieces.n_bytes[ids]))[offsets].tolist()
                for a, b, x, y, t in zip(offsets.tolist(), offsets[1:].tolist(), bytes_to, bytes_to[1:], texts):
                    same.append(decoded[x + 1 : y] == t.encode() if t else a == b)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays([row, n, pa.array(crc, pa.int64()), pa.array(same)], ["row", "n_pieces", "pieces_crc32", "lossless"])

    return run


def _seeded(docs: DataFrame, text: str, key: str, columns: list[str], seed: int) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).alias("text"), F.xxhash64(F.lit(seed), F.col(key)).alias("seed"))


def encode(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = 0, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if None) with n_pieces and pieces, the sampled piece ids of each text."""
    columns = docs.columns if keep is None else keep
    rows = _seeded(docs, text, key, columns, seed)
    out = rows.mapInArrow(_run(path, alpha, False), rows.select("row").schema.add("n_pieces", "integer").add("pieces", T.ArrayType(T.IntegerType())))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "n_pieces", "pieces")


def decode(rows: DataFrame, path: str, pieces: str = "pieces") -> DataFrame:
    """rows with decoded, the text of the pieces."""

    def run(batches):
        m = model(path)
        for batch in batches:
            texts = [None if x is None else m.decode(np.array(x, np.int64)).decode()[1:] for x in batch.column(pieces).to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return rows.mapInArrow(run, rows.select("*").schema.add("decoded", "string"))


def report(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_pieces, pieces_crc32 and lossless (decoding gives the text back) for each row."""
    rows = _seeded(docs, text, key, [key], seed)
    out = rows.mapInArrow(_run(path, alpha, True), rows.select("row").schema.add("n_pieces", "integer").add("pieces_crc32", "long").add("lossless", "boolean"))
    return out.select(F.col(f"row.`{key}`").alias(key), "n_pieces", "pieces_crc32", "lossless")
