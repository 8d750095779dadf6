"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Sizes are words; targets share the whole by weight, each up to REPEATS times its source, the excess reshared.
2. A source's documents are dealt by hash into blocks of about BLOCK_DOCS documents, whose order by number is the
   source's permutation. A pass takes every block once; the target is so many whole passes and the first blocks of
   one more, the last of them in part (a block's first documents). That gives each source an exact quota of block slots.
3. The splitting tree deals the quotas among the output shards: a node's slots are split between its halves by a
   multivariate hypergeometric draw (source after source, each drawn by inverting its distribution function at a hashed
   uniform number), down to single shards.
4. A shard takes consecutive slots of each source, that is disjoint blocks of the permutation, and shuffles them by hash.

What is decided comes to one row a source (`plan`): blocks, passes, the block where the last pass ends, the last document
taken there, and the offsets of the shards. Each document finds its own slots from that row, so documents are neither
grouped nor joined with one another. The end of the last pass is looked for in three steps (spans of SPAN blocks, blocks of
one span, documents of one block), so that no task gets all blocks of a source. Sources are taken to be few: their table
is ordered in one task, and a node of the tree is a row with a number for each source.

No draw depends on the order of rows, so reruns agree. The only shuffle of whole rows is that of `mix` to its shards.

Defined results: null text has size 0 and is taken as often as its block; the null source is a source, the last;
sources of size 0 have target 0 and nothing taken; rows repeated whole share one decision; an empty table gives an empty
result; other columns pass through `mix`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop, partitions, stage

BLOCK_DOCS = 256
SPAN = 4096
SHARDS = 16
REPEATS = 3
SEED = 20240501


def uniform(*what: Column) -> Column:
    """A hashed number between 0 and 1, both excluded."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *what), 11).cast("double") + 0.5) / float(1 << 53)


def sized(docs: DataFrame, text: str, source: str, key: str, *more: Column) -> DataFrame:
    """key, source, size and a hash for each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("__id"), F.col(source).alias("__source"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("__size"), F.xxhash64(F.lit(SEED), F.col(key), t).alias("__h"), *more)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """source, n, source_size -> with __sid (rank by code point), weight and target: one row a source. Sources are few, so one task orders them."""
    by_code = Window.orderBy(F.col("__source").cast("binary").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("__sid") % len(weights))
    ranked = sizes.withColumn("__sid", F.row_number().over(by_code) - 1).withColumn("__w", w).withColumn("__cap", F.col("__source_size").cast("double") * repeats)
    # sources reach their cap in the order of cap / weight: share out what the earlier ones leave
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").cast("binary").asc_nulls_last())
    earlier, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumns({
        "__left": F.sum("__source_size").over(all_rows) - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0)),
        "__open": F.sum("__w").over(all_rows) - F.coalesce(F.sum("__w").over(earlier), F.lit(0.0)),
    })
    ranked = ranked.withColumn("__rate", F.col("__left") / F.col("__open"))
    capped = F.col("__rate") * F.col("__w") >= F.col("__cap")
    rate = F.first(F.when(~capped, F.col("__rate")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("__target", F.when(capped, F.col("__cap")).otherwise(F.least(rate * F.col("__w"), F.col("__cap")))).drop("__left", "__open", "__rate", "__cap")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _lgamma(n: Column) -> Column:
    """log n! by Stirling's series (n of at least 16) or a table below that."""
    small = F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), n.cast("int"))
    x = F.greatest(n.cast("double"), F.lit(1.0))
    return F.when(n < 16, small).otherwise(x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))


def _hypergeometric(k: Column, rest: Column, n: Column, u: Column) -> Column:
    """Of n slots drawn from k of one source and `rest` others, those of the source: the distribution function inverted at u.

    The range within 12 standard deviations of the mean is walked, each weight from the one before; what lies beyond has
    a weight under 1e-30."""
    low, high = F.greatest(F.lit(0).cast("long"), n - rest), F.least(k, n)
    total = (k + rest).cast("double")
    mean = n * k / total
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (rest / total) * ((total - n) / F.greatest(total - 1, F.lit(1.0)))))

    def walk(r: Column) -> Column:
        a, b = r["a"], r["b"]
        logs = F.transform(F.array(k, rest, n, k + rest - n, a, k - a, n - a, rest - n + a, k + rest), _lgamma)
        signs = F.array(*[F.lit(float(s)) for s in (1, 1, 1, 1, -1, -1, -1, -1, -1)])
        first = F.exp(F.aggregate(F.zip_with(logs, signs, lambda x, s: x * s), F.lit(0.0), lambda t, x: t + x))
        ratio = lambda x: (k - x).cast("double") * (n - x) / ((x + 1).cast("double") * (rest - n + x + 1))
        got = F.aggregate(
            F.sequence(a, b),
            F.struct(first.alias("w"), F.lit(0.0).alias("below"), F.lit(-1).cast("long").alias("got")),
            lambda t, x: F.struct((t["w"] * ratio(x)).alias("w"), (t["below"] + t["w"]).alias("below"), F.when((t["got"] < 0) & (t["below"] + t["w"] >= u), x).otherwise(t["got"]).alias("got")),
        )["got"]
        return F.coalesce(F.nullif(got, F.lit(-1).cast("long")), b)

    reach = F.struct(F.greatest(low, (mean - 12 * sd - 12).cast("long")).alias("a"), F.least(high, (mean + 12 * sd + 12).cast("long")).alias("b"))
    return F.when((k + rest == 0) | (low >= high), low).otherwise(_let(reach, walk))


def split(quotas: DataFrame, shards: int) -> DataFrame:
    """(source, quota) -> (source, shard, q, offset): the splitting tree over the shards, a staged table a level."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("__sid", "__quota"))).alias("list")).select(
        F.lit(0).alias("node"), F.lit(shards).alias("width"), F.col("list.__sid").alias("sids"), F.col("list.__quota").alias("q"))
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        half = F.floor((F.col("width") + 1) / 2).cast("int")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda t, x: t + x)
        # what is open before each source: slots that are left over, and those still to be drawn for the left half
        start = F.struct(total.alias("all"), F.floor(total * half / F.col("width")).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))
        drawn = F.aggregate(
            F.arrays_zip("sids", "q"),
            start,
            lambda t, x: _let(
                _hypergeometric(x["q"], t["all"] - x["q"], t["n"], uniform(F.col("node"), F.col("width"), x["sids"])),
                lambda got: F.struct((t["all"] - x["q"]).alias("all"), (t["n"] - got).alias("n"), F.concat(t["out"], F.array(got)).alias("out"))),
        )["out"]
        halves = node.select("node", "width", "sids", "q", half.alias("half"), F.when(F.col("width") > 1, drawn).otherwise(F.col("q")).alias("left"))
        left = F.struct(F.col("node"), F.least("half", "width").alias("width"), "sids", F.col("left").alias("q"))
        right = F.struct((F.col("node") + F.col("half")).alias("node"), (F.col("width") - F.col("half")).alias("width"), "sids", F.zip_with("q", "left", lambda x, y: x - y).alias("q"))
        below = stage(halves.select(F.inline(F.filter(F.array(left, right), lambda x: x["width"] > 0))), "mix-split")
        if hasattr(node, "staged_path"):
            drop(node)
        node = below
    each = node.select(F.col("node").alias("__shard"), F.explode(F.arrays_zip("sids", "q")).alias("x")).select("__shard", F.col("x.sids").alias("__sid"), F.col("x.q").alias("__q"))
    before = Window.partitionBy("__sid").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("__offset", F.coalesce(F.sum("__q").over(before), F.lit(0).cast("long")))


def _where_it_ends(parts: DataFrame, by: str) -> DataFrame:
    """Of the parts (__sid, by, __words) of each source in order, the one within which the running sum passes __room, with what is left for it."""
    order = Window.partitionBy("__sid").orderBy(by)
    before = parts.withColumn("__before", F.sum("__words").over(order) - F.col("__words"))
    return before.where((F.col("__before") <= F.col("__room")) & (F.col("__room") < F.col("__before") + F.col("__words"))).select("__sid", by, (F.col("__room") - F.col("__before")).alias("__room"))


def plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", shards: int = SHARDS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source, staged: __source, __source_size, __target, __blocks, __passes, __end (block), __last (document) and __shares."""
    light = stage(sized(docs, text, source, key), "mix-sizes")
    sizes = light.groupBy("__source").agg(F.count("*").alias("__n"), F.sum("__size").alias("__source_size"))
    passes = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0).cast("long")
    ranked = targets(sizes, weights).withColumns({"__blocks": F.ceil(F.col("__n") / BLOCK_DOCS), "__passes": passes})
    per_source = stage(ranked.withColumn("__room", F.col("__target") - F.col("__passes") * F.col("__source_size")), "mix-sources")
    dealt = with_source(light, per_source.select("__source", "__sid", "__blocks", "__room")).withColumn("__block", F.pmod("__h", "__blocks")).withColumn("__span", F.floor(F.col("__block") / SPAN))
    blocks = stage(dealt.groupBy("__sid", "__span", "__block").agg(F.sum("__size").alias("__words"), F.first("__room").alias("__room")), "mix-blocks")
    spans = blocks.groupBy("__sid", "__span").agg(F.sum("__words").alias("__words"), F.first("__room").alias("__room"))
    span = stage(_where_it_ends(spans, "__span"), "mix-span")
    end = stage(_where_it_ends(blocks.drop("__room").join(span, ["__sid", "__span"]), "__block"), "mix-end")
    # the documents of that block in order of hash, rows repeated whole as one: the last that comes nearer to the target
    those = dealt.drop("__room").join(end, ["__sid", "__block"]).groupBy("__sid", "__room", "__h", "__id", "__size").agg((F.count("*") * F.col("__size")).alias("__words"))
    upto = F.sum("__words").over(Window.partitionBy("__sid").orderBy("__h", "__id", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = those.withColumn("__upto", upto).where(F.col("__upto") - F.col("__words") / 2 <= F.col("__room")).groupBy("__sid").agg(F.max(F.struct("__h", "__id", "__size")).alias("__last"))
    ends = end.select("__sid", F.col("__block").alias("__end")).join(last, "__sid", "left")
    decided = stage(per_source.join(ends, "__sid", "left"), "mix-decided")
    quota = F.col("__passes") * F.col("__blocks") + F.coalesce(F.col("__end") + F.when(F.col("__last").isNotNull(), 1).otherwise(0), F.lit(0))
    shares = split(decided.select("__sid", quota.cast("long").alias("__quota")), shards).groupBy("__sid").agg(F.array_sort(F.collect_list(F.struct("__offset", "__shard"))).alias("__shares"))
    out = stage(decided.join(shares, "__sid").select("__source", "__source_size", "__target", "__blocks", "__passes", "__end", "__last", "__shares"), "mix-plan")
    drop(light, per_source, blocks, span, end, decided)
    return out


def with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows joined with the row of their __source (null too): small against the documents, and Spark broadcasts it only if its size allows."""
    facts = per_source.withColumnRenamed("__source", "__s")
    return rows.join(facts, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")


def slots() -> Column:
    """The slots of a row that has __h, __id, __size and its source's plan: array of (pass, shard), one for each time that it is taken."""
    block = F.pmod("__h", "__blocks")
    more = (block < F.col("__end")) | ((block == F.col("__end")) & F.coalesce(F.struct("__h", "__id", "__size") <= F.col("__last"), F.lit(False)))
    times = F.col("__passes") + F.coalesce(more, F.lit(False)).cast("long")
    # the last share that starts at or before the slot; empty shares before it start at the same place
    shard = lambda at: F.element_at(F.filter("__shares", lambda x: x["__offset"] <= at), -1)["__shard"]
    slot = lambda p: F.struct(p.cast("int").alias("pass"), shard(p * F.col("__blocks") + block).alias("shard"))
    return F.when(times > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), slot)).otherwise(F.array().cast("array<struct<pass:int,shard:int>>"))


def summary(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """key, size, source_size, target, taken for each row."""
    rows = with_source(sized(docs, text, source, key), plan(docs, text, source, key, shards))
    return rows.select(F.col("__id").alias(key), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.coalesce("__target", F.lit(0.0)).alias("target"), (F.col("__size") * F.size(slots())).alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", shards: int = SHARDS, place: bool = False) -> DataFrame:
    """The mix itself: each row as often as it is taken, dealt to its shards and shuffled there. place adds shard and pass."""
    n = partitions(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = with_source(sized(docs, text, source, key, whole), plan(docs, text, source, key, shards))
    taken = rows.select("__row", "__h", F.explode(slots()).alias("__slot"))
    dealt = taken.repartition(n, F.col("__slot.shard"), F.pmod("__h", F.lit(n))).sortWithinPartitions(F.col("__slot.shard"), F.xxhash64("__h", "__slot.pass"))
    out = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return dealt.select(*out, *([F.col("__slot.shard").alias("shard"), F.col("__slot.pass").alias("pass")] if place else []))
