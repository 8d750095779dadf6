"""Corpus mode: the DataFrame is the array, its rows are the elements. All of it is DataFrame plans, for Catalyst to optimise.

Order is a column (or several) that the caller names; null keys come first, as in the language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import order


def _cols(df: DataFrame, names: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in names])


def select(df: DataFrame, p: Column) -> DataFrame:
    """Rows for which p is neither null nor false."""
    return df.where(p)


def project(df: DataFrame, **fields: Column) -> DataFrame:
    """{name: expression, ...} for each row."""
    return df.select(*[c.alias(n) for n, c in fields.items()])


def both(df: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The comma: the outputs of all branches."""
    out = branches[0](df)
    for b in branches[1:]:
        out = out.unionByName(b(df))
    return out


def product(df: DataFrame, **arrays: Column) -> DataFrame:
    """Object construction with several values for a field: all combinations, within each row, the first field slowest."""
    for name, a in arrays.items():
        df = df.withColumn(name, F.explode(a))
    return df


def iterate(df: DataFrame, a: Column, value: str = "value", place: str | None = None, optional: bool = False) -> DataFrame:
    """.[]: a row for each element, with its place if asked for. Null cannot be iterated and is an error; optional (.[]?) passes over it."""
    if not optional:
        a = F.coalesce(a, F.raise_error(F.lit("Cannot iterate over null")))
    return df.select("*", F.posexplode(a).alias(place, value)) if place else df.select("*", F.explode(a).alias(value))


def group_agg(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """group_by(f) | map({...}): one shuffle of partial aggregates."""
    return df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])


def group_collect(df: DataFrame, by: list[str], order: list[str], item: Column, name: str = "items") -> DataFrame:
    """group_by(f) itself: each group's members in order. A group must fit into one row, as in the language."""
    rows = df.select(*by, F.struct(*[F.col(o) for o in order], item.alias("__item")).alias("__m"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("__m")), lambda m: m["__item"]).alias(name))


def _ordered(df: DataFrame, names: list[str] | tuple[str, ...]) -> list[Column]:
    """Keys that put NaN before the numbers; columns of other types as they are."""
    kinds = dict(df.dtypes)
    return [order(F.col(f"`{n}`")) if kinds.get(n) in ("double", "float") else F.col(f"`{n}`") for n in names]


def sort_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    """A range-partitioned sort; null first, then NaN. Add the order column last for stability. A Column is taken as it is, with its own direction."""
    return df.orderBy(*[_ordered(df, [k])[0] if isinstance(k, str) else k for k in keys])


def top_k(df: DataFrame, k: int, *keys: Column | str) -> DataFrame:
    """sort_by(f) | .[:k]: k rows a task, then k in all."""
    return sort_by(df, *keys).limit(k)


def unique_by(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, so that partial results are combined before the shuffle and no key is held whole."""
    rest = [c for c in df.columns if c not in by]
    got = df.groupBy(*by).agg(F.min_by(_cols(df, rest), _cols(df, order)).alias("__first"))
    return got.select(*by, "__first.*").select(*df.columns)


def unique(df: DataFrame) -> DataFrame:
    return df.distinct()


def min_by(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the least keys, the first of several in order of `by`. Null is least, then NaN."""
    return df.agg(F.min_by(_cols(df, df.columns), F.struct(*_ordered(df, [*keys, *by])).alias("k")).alias("m")).select("m.*")


def max_by(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the greatest keys, the last of several in order of `by`."""
    return df.agg(F.max_by(_cols(df, df.columns), F.struct(*_ordered(df, [*keys, *by])).alias("k")).alias("m")).select("m.*")


def add(df: DataFrame, value: Column, name: str = "total") -> DataFrame:
    """Sum of numbers; null for no rows."""
    return df.agg(F.sum(value).alias(name))


def any_(df: DataFrame, p: Column, name: str = "any") -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(p), F.lit(False)).alias(name))


def any_all(df: DataFrame, some: Column, every: Column) -> DataFrame:
    """any and all in one pass."""
    return df.agg(F.coalesce(F.bool_or(some), F.lit(False)).alias("any"), F.coalesce(F.bool_and(F.coalesce(every, F.lit(False))), F.lit(True)).alias("all"))


def all_(df: DataFrame, p: Column, name: str = "all") -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(F.coalesce(p, F.lit(False))), F.lit(True)).alias(name))


def first(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(1)


def last(df: DataFrame, *order: str) -> DataFrame:
    """The last row; a row of nulls where there is none, as in the language."""
    return df.agg(F.max_by(_cols(df, df.columns), F.struct(*_ordered(df, order))).alias("m")).select("m.*")


def limit(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows; all of them for a negative n."""
    return df if n < 0 else df.orderBy(*order).limit(n)


def nth(df: DataFrame, n: int, *order: str) -> DataFrame:
    if n < 0:
        raise ValueError("Out of bounds negative array index")
    return df.orderBy(*order).offset(n).limit(1)


def foreach(df: DataFrame, by: list[str], order: list[str], **states: Column) -> DataFrame:
    """Running aggregates within each key (sum, min, max, count, last, ...)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({n: a.over(w) for n, a in states.items()})


def running_total(df: DataFrame, order: str, value: str, width: int, name: str = "running") -> DataFrame:
    """The fold over the whole corpus, in order of a whole number: totals of ranges of `width` values of it are summed up
    first, those again by `width` ranges, then each range runs by itself. No task holds more than a range, but for one
    with a row for each width * width values."""

    def before(parts: DataFrame, of: str, within: Window | None = None) -> DataFrame:
        window = (Window.partitionBy(within) if within else Window.partitionBy()).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
        return parts.withColumn("__before", F.coalesce(F.sum("__total").over(window), F.lit(0)))

    ranged = df.withColumn("__range", F.floor(F.col(order) / width)).withColumn("__span", F.floor(F.col("__range") / width))
    ranges = ranged.groupBy("__span", "__range").agg(F.sum(value).alias("__total"))
    spans = before(ranges.groupBy("__span").agg(F.sum("__total").alias("__total")), "__span").select("__span", F.col("__before").alias("__outer"))
    starts = before(ranges, "__range", "__span").join(spans, "__span").select("__range", (F.col("__before") + F.col("__outer")).alias("__start"))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.withColumn("__within", F.sum(value).over(within)).join(starts, "__range")
    return run.withColumn(name, F.col("__start") + F.col("__within")).drop("__range", "__span", "__within", "__start")


def neighbours(df: DataFrame, by: list[str], order: list[str], value: str, distance: int = 1) -> DataFrame:
    """.[i - 1] and .[i + 1] beside each element."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"before": F.lag(value, distance).over(w), "after": F.lead(value, distance).over(w)})


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """to_entries of a group: each element's place from zero."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def chunks(df: DataFrame, by: list[str], order: list[str], n: int, name: str = "chunk") -> DataFrame:
    """_nwise(n): the number of the run of n that each element falls into."""
    return number_rows(df, by, order, "__place").withColumn(name, F.floor(F.col("__place") / n)).drop("__place")


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def _same(a: DataFrame, b: DataFrame) -> Column:
    on = None
    for c in a.columns:
        one = a[c].eqNullSafe(b[c])
        on = one if on is None else on & one
    return on


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that equal none of b; unlike EXCEPT, repeated rows stay repeated."""
    return a.join(b, _same(a, b), "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """A - (A - B): rows of a that equal one of b, repeated ones too."""
    return a.join(b, _same(a, b), "left_semi")


def join(a: DataFrame, b: DataFrame, on: Column | list[str]) -> DataFrame:
    """A[] as $a | B[] as $b | select($a.k == $b.k): an equi-join, whose strategy Spark picks by the sides' sizes."""
    return a.join(b, on, "inner")


def lookup(a: DataFrame, b: DataFrame, on: Column | list[str]) -> DataFrame:
    """$map[.key]: null where the key is missing."""
    return a.join(b, on, "left")


def semi(a: DataFrame, b: DataFrame, on: Column | list[str]) -> DataFrame:
    return a.join(b, on, "left_semi")


def anti(a: DataFrame, b: DataFrame, on: Column | list[str]) -> DataFrame:
    return a.join(b, on, "left_anti")


def interval_join(a: DataFrame, b: DataFrame, point: str, begin: str, end: str, width: int) -> DataFrame:
    """select($b.begin <= $a.point and $a.point < $b.end): both sides are dealt to cells of `width`, so it is an equi-join with a filter."""
    left = a.withColumn("__cell", F.floor(F.col(point) / width))
    right = b.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))))
    return left.join(right, "__cell").where((F.col(begin) <= F.col(point)) & (F.col(point) < F.col(end))).drop("__cell")
