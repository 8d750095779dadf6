"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

Vectors are dealt to shards of about `shard` rows by a hash of their identifier, so a shard's size is bounded whatever
the table's: it should be as large as an executor's memory and BLAS allow, since each query meets each shard once. A shard's
graph has levels: each node reaches level l with a chance of 1/M**l; on every level a node is joined to the nearest nodes
that are nearer to it than to one already chosen, and back. Within a bounded shard the nearest nodes are found exactly, so
the graph doesn't depend on an order of insertion, and building takes time in proportion to the table. It is stored as
flat arrays (identifiers, vectors, neighbours level by level) in one row a shard, a Parquet table that can be kept and
searched again. Vectors of equal direction are one node, which keeps all their identifiers; of a vector that is repeated
no more than k + 1 rows are scored for a query.

Queries go in blocks of `block` against each shard, cogrouped, so a graph is read once for a whole block and what is
shuffled is the index once a block and each query once a shard. A beam of EF nodes is walked for many queries at a time;
what is found is scored again in double precision, and only the k best of a shard go on to be merged.

Defined results: rows whose vector is null, zero, or holds null or non-finite components, and rows without identifier,
take no part; rows that share the query's identifier are not its candidates; vectors are compared only with those of
equal length; ties go to the smaller identifier; fewer candidates than k give fewer rows; an empty table gives an empty
result. Recall against brute force is measured in the tests and the README.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARD = 16_384
M = 16
NEAREST = 64
EF = 128
QUERY_BLOCK = 65_536
#: Queries that walk the graph together.
TOGETHER = 512
INDEX = "shard string, dim int, ids binary, node_of binary, vectors binary, entry int, levels array<struct<nodes:binary,links:binary>>"


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(vector).alias("dim"))


def _links(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbours (-1 for none) of each of few unit vectors: the near ones that no nearer chosen one shadows, joined back."""
    n = len(x)
    if n < 2:
        return np.full((n, most), -1, np.int32)
    near = min(NEAREST, n - 1)
    chosen = np.full((n, most), -1, np.int32)
    for a in range(0, n, 256):
        rows = np.arange(a, min(a + 256, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        cand = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        own = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        among = np.einsum("bid,bjd->bij", x[cand], x[cand])
        kept = np.zeros(cand.shape, bool)
        for c in range(near):
            shadowed = (kept & (among[:, c, :] >= own[:, c, None])).any(1)
            kept[:, c] = ~shadowed & (kept.sum(1) < most // 2)
        for c in range(near):  # room that is left goes to the nearest others
            kept[:, c] |= kept.sum(1) < most // 2
        place = np.cumsum(kept, 1) - 1
        r, c = np.nonzero(kept)
        chosen[rows[r], place[r, c]] = cand[r, c]
    # back links, for each node the nearest first, as far as there is room
    src, at = np.nonzero(chosen >= 0)
    dst = chosen[src, at]
    sim = np.einsum("ij,ij->i", x[src], x[dst])
    order = np.lexsort((-sim, dst))
    src, dst = src[order], dst[order]
    fill = (chosen >= 0).sum(1)
    known = [set(r[r >= 0].tolist()) for r in chosen]
    for s, d in zip(src.tolist(), dst.tolist()):
        if fill[d] < most and s not in known[d]:
            chosen[d, fill[d]] = s
            fill[d] += 1
            known[d].add(s)
    return chosen


def build(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """The graph of one shard as flat arrays; rows are in order of identifier."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    unit = vectors / np.linalg.norm(vectors / np.abs(vectors).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(vectors).max(1, keepdims=True)
    _, first, node_of = np.unique(np.round(unit, 10) + 0.0, axis=0, return_index=True, return_inverse=True)
    x = unit[first].astype(np.float32)
    draw = np.random.default_rng(len(x)).random(len(x))
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(M)).astype(int)
    levels = []
    for at in range(level.max() + 1):
        nodes = np.flatnonzero(level >= at).astype(np.int32)
        local = _links(x[nodes], 2 * M if at == 0 else M)
        levels.append((nodes, np.where(local >= 0, nodes[local], -1).astype(np.int32)))
    return {"ids": ids, "node_of": node_of.reshape(-1).astype(np.int32), "vectors": vectors, "x": x, "entry": int(levels[-1][0][0]), "levels": levels}


def _beam(graph: dict, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit query the ef nearest nodes found (-1 for none) and their similarities."""
    x, n = graph["x"], len(graph["x"])
    here = np.full(len(q), graph["entry"])
    sim = np.einsum("ij,ij->i", q, x[here])
    for nodes, links in graph["levels"][:0:-1]:
        where = np.full(n, -1)
        where[nodes] = np.arange(len(nodes))
        while True:
            nb = links[where[here]]
            s = np.where(nb >= 0, np.einsum("id,ijd->ij", q, x[nb]), -np.inf)
            best = s.argmax(1)
            value = s[np.arange(len(q)), best]
            better = value > sim
            if not better.any():
                break
            here = np.where(better, nb[np.arange(len(q)), best], here)
            sim = np.where(better, value, sim)
    links = graph["levels"][0][1]
    ef = min(ef, n)
    found, sims = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32)
    found[:, 0], sims[:, 0] = here, sim
    done = np.ones((len(q), ef), bool)
    done[:, 0] = False
    seen = np.zeros((len(q), n), bool)
    seen[np.arange(len(q)), here] = True
    active = np.arange(len(q))
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        pick = open_sims.argmax(1)
        going = open_sims[np.arange(len(active)), pick] > -np.inf
        active, pick = active[going], pick[going]
        if not len(active):
            break
        done[active, pick] = True
        nb = links[found[active, pick]]
        fresh = (nb >= 0) & ~seen[active[:, None], nb]
        r, c = np.nonzero(fresh)
        seen[active[r], nb[r, c]] = True
        s = np.full(nb.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", q[active[r]], x[nb[r, c]])
        all_found = np.concatenate([found[active], nb], 1)
        all_sims = np.concatenate([sims[active], s], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        found[active] = np.take_along_axis(all_found, top, 1)
        sims[active] = np.take_along_axis(all_sims, top, 1)
        done[active] = np.take_along_axis(all_done, top, 1)
    return np.where(np.isfinite(sims), found, -1), sims


def search(graph: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF):
    """(query, identifier, score) of the k nearest of the shard for each query, scored in double precision."""
    scale = np.abs(queries).max(1, keepdims=True)
    q = (queries / scale / np.linalg.norm(queries / scale, axis=1, keepdims=True)).astype(np.float32)
    found = np.concatenate([_beam(graph, q[at : at + TOGETHER], ef)[0] for at in range(0, len(q), TOGETHER)])
    # rows in order of identifier; of bitwise equal vectors the first k + 1 are enough, as one may be the query's own
    _, same = np.unique(graph["vectors"], axis=0, return_inverse=True)
    order = np.argsort(same.reshape(-1), kind="stable")
    counts = np.bincount(same.reshape(-1))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.flatnonzero(rank <= k)
    by_node = first[np.argsort(graph["node_of"][first], kind="stable")]
    begin = np.searchsorted(graph["node_of"][by_node], np.arange(len(graph["x"]) + 1))
    norms = np.sqrt((graph["vectors"] ** 2).sum(1))
    for i in range(len(q)):
        rows = np.concatenate([by_node[begin[f] : begin[f + 1]] for f in found[i][found[i] >= 0]])
        rows = rows[graph["ids"][rows] != query_ids[i]]
        if not len(rows):
            continue
        score = graph["vectors"][rows] @ queries[i] / (norms[rows] * np.sqrt((queries[i] ** 2).sum()))
        top = np.lexsort((graph["ids"][rows], -score))[:k]
        yield int(query_ids[i]), graph["ids"][rows[top]], score[top]


def _pack(key, table):
    ids = table["id"].to_numpy()
    vectors = _matrix(table["v"])
    g = build(ids, vectors)
    levels = [{"nodes": a.tobytes(), "links": b.tobytes()} for a, b in g["levels"]]
    row = {"shard": key[0].as_py(), "dim": vectors.shape[1], "ids": g["ids"].astype(np.int64).tobytes(), "node_of": g["node_of"].tobytes(), "vectors": g["vectors"].tobytes(), "entry": g["entry"], "levels": levels}
    kinds = pa.schema([("shard", pa.string()), ("dim", pa.int32()), ("ids", pa.binary()), ("node_of", pa.binary()), ("vectors", pa.binary()), ("entry", pa.int32()), ("levels", pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())])))])
    return pa.Table.from_pylist([row], kinds)


def _unpack(row: dict) -> dict:
    ids, node_of = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["node_of"], np.int32)
    vectors = np.frombuffer(row["vectors"]).reshape(len(ids), row["dim"])
    scale = np.abs(vectors).max(1, keepdims=True)
    unit = vectors / scale / np.linalg.norm(vectors / scale, axis=1, keepdims=True)
    _, first = np.unique(node_of, return_index=True)
    levels = []
    for at in row["levels"]:
        nodes = np.frombuffer(at["nodes"], np.int32)
        levels.append((nodes, np.frombuffer(at["links"], np.int32).reshape(len(nodes), -1)))
    return {"ids": ids, "node_of": node_of, "vectors": vectors, "x": unit[first].astype(np.float32), "entry": row["entry"], "levels": levels}


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(k: int, ef: int):
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(graphs: pa.Table, queries: pa.Table) -> pa.Table:
        if not graphs.num_rows or not queries.num_rows:
            return kinds.empty_table()
        out = list(search(_unpack(graphs.to_pylist()[0]), queries["id"].to_numpy(), _matrix(queries["v"]), k, ef))
        if not out:
            return kinds.empty_table()
        which = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
        return pa.table([pa.array(which, pa.int64()), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))], kinds)

    return run


def index(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", shard: int = SHARD) -> DataFrame:
    """One row a shard and vector length: the graph as flat arrays."""
    rows = usable(vectors, vector, key)
    n = max(1, -(-vectors.count() // shard))
    return rows.withColumn("shard", F.concat_ws("-", "dim", F.pmod(F.xxhash64("id"), F.lit(n)))).groupBy("shard").applyInArrow(_pack, INDEX)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", ef: int = EF, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of queries."""
    graphs = stage(index(vectors, vector, key, shard), "hnsw-index")
    n = max(1, -(-vectors.count() // shard))
    blocks = max(1, -(-queries.count() // block))
    # each query goes to the n shards of its vector length, each graph to the blocks
    asked = usable(queries, vector, key).dropDuplicates(["id"]).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    asked = asked.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.concat_ws("-", "dim", "number").alias("shard"), "block", "id", "v")
    dealt = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
