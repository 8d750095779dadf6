"""N-gram Jaccard self-join with Bayesian candidate pruning.

Shingles are runs of SHINGLE words (a text of fewer words is one shingle); documents are linked if the Jaccard similarity
of their shingle sets is THRESHOLD or more.

1. Each whole text gives a key of its shingle set and a signature of HASHES MinHash values, kept as 16 bits each.
   Documents of equal sets form one class; only one of each class goes on, with the number of its copies.
2. Candidates agree on all ROWS values of one of BANDS bands: a pair at the threshold is missed with a chance of 3e-6.
   A bucket of any size is dealt into chunks of CHUNK classes, and pairs of chunks are compared: no task gets a whole
   bucket, and pairs are never rows, only marks within a pair of chunks. A pair is looked at in its first common band alone.
3. Bayesian pruning: values are compared STEP at a time, and a pair is dropped once the posterior probability that its
   similarity reaches the threshold (uniform prior) is less than TOLERANCE.
4. Pairs that remain are verified exactly on their 64-bit shingle sets, again within a pair of chunks.
5. Linked classes are joined to groups (connected components of a spanning forest of the links).

Defined results: null and empty texts have no shingle, no link and stand alone; rows of equal text are copies, whether
or not they share an identifier, and copies are linked to one another; a null identifier sorts last; an empty table
gives an empty result; `representatives` keeps other columns.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import drop, lookup, stage
from .components import components

SHINGLE = 5
THRESHOLD = (4, 5)
ROWS, BANDS, HASHES, STEP = 4, 24, 128, 32
TOLERANCE = 1e-6
CHUNK = 256
#: Bytes of text whose shingles are made together, or one text.
TOGETHER = 1 << 18


def _constants() -> tuple[np.ndarray, np.ndarray]:
    x = W.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(W.BYTES))
    return (x[:HASHES] >> np.uint64(32)).astype(np.uint32), ((x[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words, first = W.word_hashes(data, offsets)
    hashes = W.window_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        elif b > a:
            out.append(W.mix(W.window_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES MinHash values of 16 bits for each set; zeros for an empty one."""
    xor, times = _constants()
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
    starts = np.append(0, np.cumsum([len(sets[i]) for i in full])[:-1])
    for h in range(HASHES):
        least = np.minimum.reduceat((flat ^ xor[h]) * times[h], starts)
        out[full, h] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def _index(k: int):
    @W.giving_back
    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column("text"))
            n, k1, k2, sig = [], [], [], []
            for a, b in W.slices(offsets, TOGETHER):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                n += [len(s) for s in sets]
                k1 += [int(W.mix(s).sum(dtype=np.uint64)) for s in sets]
                k2 += [int(W.mix(s ^ np.uint64(W.SECOND)).sum(dtype=np.uint64)) for s in sets]
                sig += [r.tobytes() for r in signatures(sets)]
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tx"), pa.array(n, pa.int32()), longs(k1), longs(k2), pa.array(sig, pa.binary())], ["id", "tx", "n", "node", "k2", "sig"])

    return run


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the fewest matches that leave a posterior probability of tolerance or more."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        posterior = lambda m: sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))  # noqa: B023, E731
        out[n] = next(m for m in range(n + 1) if posterior(m) >= tolerance)
    return out


@W.giving_back
def _candidates(batches):
    """Pairs of chunks of a bucket -> for those with candidates the classes that take part and the pairs, as places among them."""
    least = least_matches(THRESHOLD[0] / THRESHOLD[1], TOLERANCE)
    for batch in batches:
        out = []
        for at in range(batch.num_rows):  # one block at a time as Python objects
            key, lo, hi, band, chunks = (batch.column(c)[at].as_py() for c in ("key", "lo", "hi", "band", "chunks"))
            chunks.sort(key=lambda c: c["chunk"])
            members = [sorted(c["members"], key=lambda m: m["node"]) for c in chunks]
            sigs = [np.frombuffer(b"".join(m["sig"] for m in ms), np.uint16).reshape(-1, HASHES) for ms in members]
            if len(members) == 1:
                if lo != hi:
                    continue
                i, j = np.triu_indices(len(members[0]), 1)
                a = b = sigs[0]
            else:
                a, b = sigs
                i, j = (x.ravel() for x in np.mgrid[0 : len(a), 0 : len(b)])
            matches = np.zeros(len(i), np.int64)
            for v in range(0, HASHES, STEP):
                matches = matches + (a[i, v : v + STEP] == b[j, v : v + STEP]).sum(1)
                good = matches >= least[v + STEP]
                i, j, matches = i[good], j[good], matches[good]
            if len(i):
                bands = (a[i, : BANDS * ROWS] == b[j, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(2)
                good = bands.argmax(1) == band
                i, j = i[good], j[good]
            if len(i):
                if len(members) == 2:
                    j = j + len(a)
                used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
                every = [m for ms in members for m in ms]
                pairs = where.reshape(2, -1).astype(np.uint16).tobytes()
                out.append((key, lo, hi, [{"pos": p, "node": every[u]["node"], "copies": every[u]["copies"], "pairs": pairs if p == 0 else None} for p, u in enumerate(used.tolist())]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.list_(pa.struct([("pos", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("pairs", pa.binary())])))], ["key", "lo", "hi", "parts"])


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets i and j: one by one if few, else as a product of 0/1 matrices, `width` columns at a time."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kinds, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(kinds), width):
        a, b = np.searchsorted(column, [at, at + width])
        table = np.zeros((len(sets), width), np.float32)
        table[owner[a:b], column[a:b] - at] = 1
        total += table @ table.T
    return total[i, j].astype(np.int64)


@W.giving_back
def _verify(batches):
    """Blocks with their shingle sets -> for each class with links in the block: copies linked and the least class it is connected with there."""
    num, den = THRESHOLD
    for batch in batches:
        nodes, links, roots = [], [], []
        for row in batch.column("parts"):  # one block at a time as Python objects
            parts = row.as_py()
            parts.sort(key=lambda p: p["pos"])
            i, j = np.frombuffer(parts[0]["pairs"] or b"", np.uint16).reshape(2, -1).astype(np.int64)
            if not len(i) or [p["pos"] for p in parts] != list(range(max(i.max(), j.max()) + 1)) or any(p["set"] is None for p in parts):
                raise ValueError("a block lacks a part or a shingle set")
            sets = [np.frombuffer(p["set"], np.uint64) for p in parts]
            size = np.array([len(s) for s in sets])
            inter = intersections(sets, i, j)
            good = inter * den >= num * (size[i] + size[j] - inter)
            i, j = i[good], j[good]
            if not len(i):
                continue
            copies = np.array([p["copies"] for p in parts])
            mine = np.bincount(i, copies[j], len(parts)) + np.bincount(j, copies[i], len(parts))
            name = np.array([p["node"] for p in parts])
            root = name.copy()
            while True:  # least node over the links until nothing changes
                before = root.copy()
                least = np.minimum(root[i], root[j])
                np.minimum.at(root, i, least)
                np.minimum.at(root, j, least)
                if (root == before).all():
                    break
            used = np.flatnonzero(mine > 0)
            nodes.append(name[used])
            links.append(mine[used].astype(np.int64))
            roots.append(root[used])
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, links, roots)], ["node", "links", "root"])


def _sets(k: int):
    @W.giving_back
    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column("text"))
            sets = [s.tobytes() for a, b in W.slices(offsets, TOGETHER) for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """For each row its id and tx (hash of the text), first (id and tx of the first of its group), n_links and group_size."""
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tx"))
    id_type = base.schema["id"].dataType.simpleString()
    index = stage(base.mapInArrow(_index(shingle), f"id {id_type}, tx long, n int, node long, k2 long, sig binary"), "jaccard-index")
    name = F.struct(F.col("id").isNull().alias("void"), "id", "tx")
    per_set = index.where("n > 0").groupBy("node", "k2", "n").agg(F.min(F.struct(name.alias("name"), "sig")).alias("m"), F.count("*").alias("copies"))
    reps = stage(per_set.select("node", "copies", F.col("m.name").alias("name"), F.col("m.sig").alias("sig")), "jaccard-classes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("sig", b * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("key")))
    keys = reps.select("node", F.inline(bands))
    buckets = stage(keys.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1"), "jaccard-buckets")
    members = lookup(keys, buckets.withColumn("size", F.col("__n")), ["key"], "__n", reps.count() * BANDS).where("size is not null")
    members = members.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node", "band"), F.col("chunks")).cast("int"))
    chunks = members.select("node", "band", "key", "chunks", "chunk").join(reps.select("node", "copies", "sig"), "node")
    chunks = chunks.groupBy("key", "chunk", "chunks").agg(F.min("band").alias("band"), F.collect_list(F.struct("node", "copies", "sig")).alias("members"))
    alone = chunks.where("chunks = 1").select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "band", F.array(F.struct("chunk", "members")).alias("chunks"))
    several = chunks.where("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    several = several.groupBy("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")).agg(F.min("band").alias("band"), F.collect_list(F.struct("chunk", "members")).alias("chunks"))
    blocks = stage(alone.unionByName(several).mapInArrow(_candidates, "key long, lo int, hi int, parts array<struct<pos:int,node:bigint,copies:bigint,pairs:binary>>"), "jaccard-blocks")
    parts = blocks.select("key", "lo", "hi", F.inline("parts"))
    # the name as one struct is never null, so null identifiers meet too; a hot name is read without a shuffle of its rows.
    # The other texts are shuffled at any size, so a small table shows the cost of a large one
    wanted = stage(parts.select("node").distinct().join(reps.select("node", "copies", "name"), "node"), "jaccard-wanted")
    texts = lookup(base.select(name.alias("name"), "text"), wanted, ["name"], "copies", index.count(), "merge").where("node is not null")
    sets = stage(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets(shingle), "node long, set binary"), "jaccard-sets")
    whole = parts.join(sets, "node", "left").groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("pos", "node", "copies", "pairs", "set")).alias("parts"))
    found = stage(whole.select("parts").mapInArrow(_verify, "node long, links long, root long"), "jaccard-links")
    labels = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = reps.select("node", "copies", "name").join(labels, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    facts = stage(facts, "jaccard-facts")
    firsts = stage(facts.groupBy("label").agg(F.min("name").alias("first"), F.sum("copies").alias("group_size"), F.count("*").alias("__n")), "jaccard-groups")
    facts2 = stage(lookup(facts, firsts, ["label"], "__n", facts.count()).select("node", "copies", "first", "group_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-classes-done")
    light = index.select("id", "tx", "node", "n")
    out = lookup(light.where("n > 0").drop("n"), facts2, ["node"], "copies", index.count())
    void = light.where("n = 0").select("id", "tx", name.alias("first"), F.lit(1).cast("long").alias("group_size"), F.lit(0).cast("long").alias("n_links"))
    done = stage(out.select("id", "tx", "first", "group_size", "n_links").unionByName(void), "jaccard-done")
    drop(index, reps, buckets, blocks, wanted, sets, found, facts, firsts, facts2)
    return done


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, class_id (the smallest identifier of the group), group_size and n_links for each row."""
    return groups(docs, text, key).select(F.col("id").alias(key), F.col("first.id").alias("class_id"), "group_size", "n_links")


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group, with all its columns."""
    first = groups(docs, text, key).where((F.col("tx") == F.col("first.tx")) & F.col("id").eqNullSafe(F.col("first.id")))
    first = first.select(F.col("id").alias("__i"), F.col("tx").alias("__tx")).distinct()
    rows = docs.withColumns({"__id": F.col(key), "__t": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    kept = rows.join(first, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__tx")))
    return kept.dropDuplicates(["__i", "__tx"]).select(*[F.col(f"`{c}`") for c in docs.columns])
