"""Token-ID output: a content-addressed store.

Encoding: the tokenizer's pre-tokenizer cuts a text into words with the space before them, runs of digits, of signs and
of white space; the ids of these pieces, one after the other, are the text's. The cuts are found over the code points of
many texts at once, and each distinct piece is encoded by the tokenizer once per worker. A text that holds an added
token or a code point without a category, or any text of a tokenizer with other rules, is encoded whole.

Store (Parquet tables under one folder):
- chunks: digest (SHA-256 of the ids' bytes), n, uses, data (zstd): ids are cut where a rolling (gear) hash of the last 16 ids
  has its low bits zero, so equal passages give equal chunks wherever they stand; each distinct chunk is stored once;
- recipes, in ascending order of identifier: part, pos, id, n_tokens, crc, root, digests, sizes, local_start;
- manifest: part, n_docs, n_tokens and Merkle root over the part's documents, whose roots are Merkle roots over chunks.

Reading joins recipes with chunks by digest, puts each document together again in order, and verifies chunk digests,
document roots, part roots and lengths against the manifest.

Ids are little-endian, of 16 bits where the vocabulary allows, else of 32.

Defined results: null text counts as empty and gives the end id alone; rows with equal or null identifiers each have
their own recipe (null last); an empty table gives empty tables; columns other than identifier and text are not stored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from .common import drop, lookup, new_path, partitions, stage, tidy
from .words import Growing, Known, code_points, groups_of, mix, spread

#: Chunks have 2**AVERAGE ids on average, LEAST at least and MOST at most.
AVERAGE, LEAST, MOST = 11, 256, 16384
#: Distinct pieces that a worker remembers; beyond that it forgets those met only once.
REMEMBERED = 1 << 18
RECIPES = "part int, pos long, id {id}, n_tokens long, crc long, root binary, digests array<binary>, sizes array<int>, local_start long"
#: White space by its Unicode property, and the endings that are cut off after an apostrophe.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
BLANK, LETTER, DIGIT, SIGN, UNKNOWN = range(5)
_encoders: dict[str, Encoder] = {}


def _classes() -> np.ndarray:
    """The class of each code point: white space, letter, number, other, or without a category."""
    import unicodedata

    first = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((UNKNOWN if k == "Cn" else first.get(k[0], SIGN) for k in map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
    out[WHITE] = BLANK
    return out


def cuts(codes: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts start: runs of one class, each with a single space before it.

    Of white space before something else the last character is a piece of its own, or, if a space, goes with what follows."""
    n = len(codes)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    blank, space = kinds == BLANK, codes == 32
    start = begins[:-1].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    start[1:] &= ~(space[:-1] & ~blank[1:]) | begins[1:-1]  # the space before has the cut
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~begins[1:-1])
    start[last] = True
    # an apostrophe that starts a piece takes one of the endings with it
    for at in np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kinds[1:] == LETTER) & ~begins[1:-1]).tolist():
        to = at + 1 + min(2, int(np.argmax(begins[at + 1 : at + 4])) if begins[at + 1 : at + 4].any() else 2)
        after = "".join(map(chr, codes[at + 1 : to].tolist()))
        found = next((e for e in ENDINGS if after.startswith(e)), None)
        if found:
            start[at + 1 : at + 1 + len(found)] = begins[at + 1 : at + 1 + len(found)]
            if at + 1 + len(found) < n:
                start[at + 1 + len(found)] = True
    return np.flatnonzero(start)


class Encoder:
    """A tokenizer of the tokenizers library, with the ids of pieces it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        t = self.tokenizer
        vocabulary = t.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.added = [a.content for a in t.get_added_tokens_decoder().values()]
        cut = json.loads(t.pre_tokenizer.__getstate__()) if t.pre_tokenizer else {}
        by_byte = (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False) and (t.post_processor is None or type(t.post_processor).__name__ == "ByteLevel")
        self.by_piece = by_byte and t.normalizer is None and t.truncation is None and type(t.model).__name__ == "BPE" and t.model.dropout is None
        if not self.by_piece:
            return
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # byte-level: one character stands for one byte
        self.classes = _classes()
        # the byte-level alphabet: printing bytes stand for themselves, the others for characters from 256 on; 0xFF is in no UTF-8
        printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: b for b in printing} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(printing)))} | {0xFF: ord(" ")}
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.known = Known(REMEMBERED)
        self._keep(np.zeros(0, np.int64), np.zeros(0, self.kind))

    def _keep(self, counts: np.ndarray, ids: np.ndarray) -> None:
        self.ids, self.count, self.first = Growing(self.kind), Growing(np.int64), Growing(np.int64)
        self._add(counts, ids)

    def _add(self, counts: np.ndarray, ids: np.ndarray) -> None:
        self.first.add(self.ids.n + np.cumsum(counts) - counts)
        self.count.add(counts)
        self.ids.add(ids)

    def _forget(self, stay: np.ndarray) -> None:
        self._keep(counts := self.count.now[stay], self.ids.now[spread(self.first.now[stay], counts)])

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        groups = [b"\xff".join(raw[i : i + 500]).decode("latin-1").translate(self.alphabet) for i in range(0, len(raw), 500)]
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.pieces.encode_batch_fast(groups, add_special_tokens=False)])
        ends, upto = np.cumsum([len(r) for r in raw]), np.cumsum(self.width[ids])
        at = np.searchsorted(upto, ends)
        if not len(ids) or at[-1] != len(ids) - 1 or (upto[at] != ends).any():
            raise ValueError("the tokenizer's vocabulary lacks bytes")
        self._add(np.diff(np.append(-1, at)), ids)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (n + 1)."""
        if not self.by_piece:
            each = [self.plain(t) for t in texts]
            return np.concatenate([np.zeros(0, self.kind), *each]), np.append(0, np.cumsum([len(x) for x in each], dtype=np.int64))
        whole = np.array([any(a in t for a in self.added) for t in texts], bool)
        joined, codes, offsets = code_points(texts)
        kinds = self.classes[codes]
        strange = np.flatnonzero(kinds == UNKNOWN)
        whole[np.searchsorted(offsets, strange, "right") - 1] = True
        starts = cuts(codes, kinds, offsets) if len(codes) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(codes))
        text = np.searchsorted(offsets, starts, "right") - 1
        if whole.any():
            mine = ~whole[text]
            starts, ends, text = starts[mine], ends[mine], text[mine]
        number = self.known.find(joined, codes, starts, ends, self._learn, self._forget)
        counts = self.count.now[number]
        ids = self.ids.now[spread(self.first.now[number], counts)]
        n = np.bincount(text, counts, len(texts)).astype(np.int64)
        if whole.any():
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in np.flatnonzero(whole).tolist():
                parts[i] = self.plain(texts[i])
            ids, n = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, np.append(0, np.cumsum(n))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _gears() -> np.ndarray:
    return mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def rolling(ids: np.ndarray, gears: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last 16 ids lets a chunk end."""
    h = gears[ids & np.uint64(0xFFFF) if ids.dtype.itemsize > 2 else ids]
    for span in (1, 2, 4, 8):  # after the last, the sum over 16 ids of gear << distance
        h[span:] = h[span:] + (h[:-span] << np.uint64(span))
    return np.flatnonzero((h >> np.uint64(64 - AVERAGE)) == 0) + 1


def chunk_ends(allowed: list[int], n: int) -> list[int]:
    """Where the chunks of a stream of n ids end; as the least length is over 16, no end depends on what stands before the stream."""
    ends, at = [], 0
    for c in [*allowed, n]:
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c > at and (c - at >= LEAST or c == n):
            at = c
            ends.append(at)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary SHA-256 tree; leaves and inner nodes are told apart by a first byte."""
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def _encode(path: str, end_id: int):
    def run(batches):
        enc, gears, zip_ = encoder(path), _gears(), ZstdCompressor(3)
        for batch in batches:
            for low, high in groups_of(pc.utf8_length(batch.column("text")).fill_null(0).to_pylist()):
                ids, offsets = enc.encode([t or "" for t in batch.column("text").slice(low, high - low).to_pylist()])
                ids, offsets = np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
                allowed = rolling(ids, gears)
                bounds = np.searchsorted(allowed, offsets, "right").tolist()
                raw, wide = memoryview(ids.tobytes()), memoryview(ids.astype("<u4").tobytes())
                size, first = enc.kind.itemsize, offsets.tolist()
                crc, roots, digests, lengths, data, many = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(first, first[1:])):
                    ends = chunk_ends((allowed[bounds[i] : bounds[i + 1]] - a).tolist() if b - a > LEAST else [], b - a)
                    chunks = [raw[(a + x) * size : (a + y) * size] for x, y in zip([0, *ends], ends)]
                    own = [hashlib.sha256(c).digest() for c in chunks]
                    crc.append(zlib.crc32(wide[4 * a : 4 * b]))
                    roots.append(merkle(own))
                    digests += own
                    lengths += [len(c) // size for c in chunks]
                    data += [zip_.compress(c) for c in chunks]
                    many.append(len(ends))
                part = batch.slice(low, high - low)
                chunks = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(lengths, pa.int32()), pa.array(data, pa.binary())], ["digest", "n", "data"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), chunks)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(roots, pa.binary()), listed], ["id", "n_tokens", "crc", "root", "chunks"])

    return run


def _number(batches):
    """Number the sorted recipes of a part, and sum their tokens."""
    part, pos, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        sums = np.cumsum(batch.column("n_tokens").to_numpy(zero_copy_only=False))
        local = np.append(0, sums[:-1]) + start if n else sums
        columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), *[batch.column(c) for c in ("id", "n_tokens", "crc", "root", "digests", "sizes")], pa.array(local.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "pos", "id", "n_tokens", "crc", "root", "digests", "sizes", "local_start"])
        pos, start = pos + n, start + int(sums[-1]) if n else start


def _part_roots(batches):
    """Merkle roots over the documents of each part, whose rows come in order; a part is in one task."""
    part, leaves, n = None, [], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("part", "root", "n_tokens")]):
            if row[0] != part and part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(leaves)], pa.int64()), pa.array([n], pa.int64()), pa.array([merkle(leaves)], pa.binary())], ["part", "n_docs", "n_tokens", "root"])
                leaves, n = [], 0
            part = row[0]
            leaves.append(row[1])
            n += row[2]
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(leaves)], pa.int64()), pa.array([n], pa.int64()), pa.array([merkle(leaves)], pa.binary())], ["part", "n_docs", "n_tokens", "root"])


MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def _roots(recipes: DataFrame) -> DataFrame:
    spark = recipes.sparkSession
    return recipes.select("part", "pos", "root", "n_tokens").repartition(partitions(spark), "part").sortWithinPartitions("part", "pos").mapInArrow(_part_roots, MANIFEST)


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> None:
    """Encode all texts and store them under uri."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    encoded = stage(base.mapInArrow(_encode(tokenizer, end_id), f"id {id_type}, n_tokens long, crc long, root binary, chunks array<struct<digest:binary,n:int,data:binary>>"), "tokens")
    chunks = encoded.select(F.inline("chunks")).groupBy("digest").agg(F.min("n").alias("n"), F.min("data").alias("data"), F.count("*").alias("uses"))
    with tidy(spark):
        chunks.write.option("compression", "uncompressed").parquet(f"{uri}/chunks")
    order = [F.col("id").asc_nulls_last(), "crc", "n_tokens"]
    recipes = encoded.select("id", "n_tokens", "crc", "root", F.col("chunks.digest").alias("digests"), F.col("chunks.n").alias("sizes"))
    recipes = recipes.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_number, RECIPES.format(id=id_type))
    with tidy(spark):
        recipes.write.option("compression", "zstd").parquet(f"{uri}/recipes")
        _roots(spark.read.parquet(f"{uri}/recipes")).write.parquet(f"{uri}/manifest")
    drop(encoded)


def _assemble(path: str):
    def run(batches):
        kind, unzip = encoder_kind(path), ZstdDecompressor()
        for batch in batches:
            n, crc = [], []
            for row in zip(*[batch.column(c).to_pylist() for c in ("digests", "root", "n_tokens", "found")]):
                digests, root, n_tokens, found = row
                have = {f["seq"]: f for f in found or []}
                parts = []
                for i, d in enumerate(digests):
                    data = unzip.decompress(have[i]["data"], have[i]["n"] * kind.itemsize) if i in have and have[i]["data"] else b""
                    if hashlib.sha256(data).digest() != d:
                        raise ValueError("a chunk is missing or doesn't fit its digest")
                    parts.append(data)
                ids = np.frombuffer(b"".join(parts), kind)
                if merkle(digests) != root or len(ids) != n_tokens:
                    raise ValueError("a document doesn't fit its recipe")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), batch.column("id"), batch.column("local_start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "pos", "id", "local_start", "n_tokens", "ids_crc32"])

    return run


_kinds: dict[str, np.dtype] = {}


def encoder_kind(path: str) -> np.dtype:
    """The type of stored ids, from the tokenizer's file."""
    if path in _encoders:
        return _encoders[path].kind
    if path not in _kinds:
        from tokenizers import Tokenizer

        _kinds[path] = np.dtype("<u2") if max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) < 1 << 16 else np.dtype("<u4")
    return _kinds[path]


def read(spark: SparkSession, uri: str, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, put together from its chunks and verified."""
    recipes, manifest = spark.read.parquet(f"{uri}/recipes"), spark.read.parquet(f"{uri}/manifest")
    wrong = _roots(recipes).alias("a").join(manifest.alias("b"), "part", "full").where("not (a.root <=> b.root and a.n_docs <=> b.n_docs and a.n_tokens <=> b.n_tokens)")
    if wrong.limit(1).count():
        raise ValueError("the recipes don't fit the manifest")
    uses = recipes.select("part", "pos", F.posexplode("digests").alias("seq", "digest"))
    chunks = spark.read.parquet(f"{uri}/chunks")
    total = chunks.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    # a chunk that stands in many documents is brought to them, not they to it
    held = lookup(uses, chunks, ["digest"], "uses", total).groupBy("part", "pos").agg(F.collect_list(F.struct("seq", "n", "data")).alias("found"))
    id_type = recipes.schema["id"].dataType.simpleString()
    whole = recipes.join(held, ["part", "pos"], "left").mapInArrow(_assemble(tokenizer), f"part int, pos long, id {id_type}, local_start long, n_tokens long, ids_crc32 long")
    # one row a part: as many as partitions were written
    before = manifest.select("part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    return whole.join(F.broadcast(before), "part").select(F.col("id").alias("doc_id"), (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Store all documents in the shared folder and read them back."""
    spark = docs.sparkSession
    uri = new_path(spark, "token-store")
    write(docs, uri, tokenizer, end_id)
    return read(spark, uri, tokenizer)
