"""Functions of arrays within a row, by Spark's higher-order functions. In corpus mode see operators.corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import order
from .registry import builtin


def index(a: Column, i: int) -> Column:
    """a[i], from the end where negative; null beyond either end."""
    return F.get(a, i) if i >= 0 else F.get(a, F.size(a) + i)


def slice_(a: Column, begin: int | None = None, end: int | None = None) -> Column:
    """a[begin:end], bounds clamped, from the end where negative."""
    n = F.size(a)
    at = lambda i, default: default if i is None else F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    lo = F.least(at(begin, F.lit(0)), n)
    return F.slice(a, lo + 1, F.greatest(F.least(at(end, n), n) - lo, F.lit(0)))


def splice(a: Column, begin: int, end: int, values: Column) -> Column:
    """a[begin:end] = values."""
    return F.concat(slice_(a, 0, begin), values, slice_(a, end, None))


def index_of(a: Column, needle: Column) -> Column:
    """Places where the needle, an array, begins; none for an empty one."""
    last = F.size(a) - F.size(needle)
    none = F.array().cast("array<int>")
    return F.when((F.size(needle) == 0) | (last < 0), none).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(a, i + 1, F.size(needle)) == needle))


def indices(a: Column, value: Column) -> Column:
    """Places of the elements that equal value."""
    return F.transform(F.filter(F.arrays_zip(a.alias("x"), F.sequence(F.lit(0), F.size(a) - 1).alias("i")), lambda p: p["x"].eqNullSafe(value)), lambda p: p["i"])


def minus(a: Column, b: Column) -> Column:
    """Elements of a that equal none of b; repeated ones stay repeated."""
    return F.filter(a, lambda x: ~F.exists(b, lambda y: x.eqNullSafe(y)))


def plus(a: Column, b: Column) -> Column:
    return F.coalesce(F.concat(a, b), a, b)


@builtin("map/1")
def map_(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


@builtin("select/1")
def select(a: Column, p: Callable[[Column], Column]) -> Column:
    return F.filter(a, lambda x: F.coalesce(p(x), F.lit(False)))


@builtin("any/0", "any/1", "any/2")
def any_(a: Column, p: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.exists(a, lambda x: F.coalesce(p(x), F.lit(False)))


@builtin("all/0", "all/1", "all/2")
def all_(a: Column, p: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.forall(a, lambda x: F.coalesce(p(x), F.lit(False)))


@builtin("add/0")
def add(a: Column, kind: str = "double") -> Column:
    """Sum of numbers, concatenation of strings; null for an empty array."""
    zero = F.lit("") if kind == "string" else F.lit(0).cast(kind)
    fold = F.aggregate(a, zero, (lambda s, x: F.concat(s, F.coalesce(x, F.lit("")))) if kind == "string" else (lambda s, x: s + F.coalesce(x.cast(kind), F.lit(0).cast(kind))))
    return F.when(F.size(a) > 0, fold)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _keyed(a: Column, f: Callable[[Column], Column]) -> Column:
    """(key, place, element), sorted: null first, then NaN, equal keys in their order."""
    return F.sort_array(F.transform(a, lambda x, i: F.struct(order(f(x)).alias("k"), i.alias("i"), x.alias("x"))))


@builtin("sort/0")
def sort(a: Column) -> Column:
    """Ascending: null first, then NaN."""
    return F.transform(F.sort_array(F.transform(a, order)), lambda p: p["value"])


@builtin("sort_by/1")
def sort_by(a: Column, f: Callable[[Column], Column]) -> Column:
    """Ascending by f, null first, then NaN, equal keys in their order."""
    return F.transform(_keyed(a, f), lambda p: p["x"])


@builtin("unique/0")
def unique(a: Column) -> Column:
    return sort(F.array_distinct(a))


@builtin("unique_by/1")
def unique_by(a: Column, f: Callable[[Column], Column]) -> Column:
    """The first of each key, in order of the keys."""
    firsts = lambda keyed: F.filter(keyed, lambda p, i: (i == 0) | ~p["k"].eqNullSafe(F.get(keyed, F.greatest(i - 1, F.lit(0)))["k"]))
    return F.transform(_let(_keyed(a, f), firsts), lambda p: p["x"])


@builtin("group_by/1")
def group_by(a: Column, f: Callable[[Column], Column]) -> Column:
    """Array of groups in order of their keys, members in their order."""

    def groups(keyed: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(keyed)), lambda i: (i == 0) | (i == F.size(keyed)) | ~F.get(keyed, i)["k"].eqNullSafe(F.get(keyed, F.greatest(i - 1, F.lit(0)))["k"]))
        runs = lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda b, i: F.transform(F.slice(keyed, b + 1, F.get(at, i + 1) - b), lambda p: p["x"]))
        return _let(begins, runs)

    return F.when(F.size(a) == 0, F.transform(F.slice(a, 1, 0), lambda x: F.array(x))).otherwise(_let(_keyed(a, f), groups))


@builtin("min/0")
def minimum(a: Column) -> Column:
    """NaN is less than any number, null less than NaN."""
    return F.array_min(F.transform(a, order))["value"]


@builtin("max/0")
def maximum(a: Column) -> Column:
    return F.array_max(F.transform(a, order))["value"]


@builtin("min_by/1")
def min_by(a: Column, f: Callable[[Column], Column]) -> Column:
    """The first of the least."""
    return index(sort_by(a, f), 0)


@builtin("max_by/1")
def max_by(a: Column, f: Callable[[Column], Column]) -> Column:
    """The last of the greatest."""
    return index(sort_by(a, f), -1)


@builtin("reverse/0")
def reverse(a: Column) -> Column:
    return F.reverse(a)


@builtin("flatten/0", "flatten/1", "_flatten/1")
def flatten(a: Column, depth: int | None = None, kind: T.ArrayType | None = None) -> Column:
    """depth levels of nesting taken away; all that the type has, where no depth is given."""
    if depth is None:
        if kind is None:
            raise ValueError("flatten needs a depth or the array's type")
        depth, of = 0, kind.elementType
        while isinstance(of, T.ArrayType):
            depth, of = depth + 1, of.elementType
    if depth < 0:
        raise ValueError("flatten depth must not be negative")
    for _ in range(depth):
        a = F.flatten(a)
    return a


@builtin("transpose/0")
def transpose(rows: Column) -> Column:
    """Rows to columns, short rows padded with null."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))


@builtin("combinations/0")
def combinations(*arrays: Column) -> Column:
    """All ways to take one element of each, the first array slowest."""

    def longer(heads: Column, a: Column) -> Column:
        return F.flatten(F.transform(heads, lambda head: F.transform(a, lambda x: F.concat(head, F.array(x)))))

    out = F.transform(arrays[0], lambda x: F.array(x))
    for a in arrays[1:]:
        out = longer(out, a)
    return out


@builtin("combinations/1")
def combinations_n(a: Column, n: int) -> Column:
    return combinations(*[a] * n)


@builtin("_nwise/1", "_nwise/2")
def nwise(a: Column, n: int) -> Column:
    """Runs of n elements, the last one shorter."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / n).cast("int") - 1, F.lit(0))), lambda i: F.slice(a, i * n + 1, n))


@builtin("first/0", "first/1")
def first(a: Column) -> Column:
    return index(a, 0)


@builtin("last/0", "last/1")
def last(a: Column) -> Column:
    return index(a, -1)


@builtin("nth/1", "nth/2")
def nth(a: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("Out of bounds negative array index")
    return index(a, n)


@builtin("limit/2")
def limit(a: Column, n: int) -> Column:
    """The first n; all of them for a negative n."""
    return a if n < 0 else F.slice(a, 1, n) if n else F.slice(a, 1, 0)


@builtin("range/1", "range/2", "range/3")
def range_(begin: Column, end: Column, step: Column | int = 1) -> Column:
    """Whole numbers from begin up to end, end excluded; none for a step of zero."""
    s = F.lit(step) if isinstance(step, int) else step
    n = F.when(s == 0, 0).otherwise(F.greatest(F.ceil((end - begin) / F.when(s == 0, 1).otherwise(s)).cast("int"), F.lit(0)))
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")), lambda i: begin + i * s)


def reduce(a: Column, init: Column, update: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, init, update)


def foreach(a: Column, init: Column, update: Callable[[Column, Column], Column], kind: str = "double") -> Column:
    """All states of the fold, in order."""
    start = F.struct(init.cast(kind).alias("state"), F.array().cast(f"array<{kind}>").alias("all"))

    def step(acc, x):
        new = update(acc["state"], x).cast(kind)
        return F.struct(new.alias("state"), F.concat(acc["all"], F.array(new)).alias("all"))

    return F.aggregate(a, start, step)["all"]


def contains(a: Column, b: Column) -> Column:
    """Each element of b is within some element of a (equality; for strings, part of)."""
    return F.forall(b, lambda y: F.exists(a, lambda x: x.eqNullSafe(y)))


def contains_strings(a: Column, b: Column) -> Column:
    return F.forall(b, lambda y: F.exists(a, lambda x: F.contains(x, y)))


@builtin("contains/1", "inside/1")
def contains_all(a: Column, ka: T.DataType, b: Column, kb: T.DataType) -> Column:
    """a contains b, at any depth: strings as parts, arrays if each element of b is contained in one of a, objects if each
    field of b is contained in a's field of that name; anything else if equal. Null contains null alone."""
    if isinstance(kb, T.StructType):
        fields = {x.name: x.dataType for x in ka} if isinstance(ka, T.StructType) else {}
        every = F.lit(True)
        for x in kb:
            every = every & (contains_all(a[x.name], fields[x.name], b[x.name], x.dataType) if x.name in fields else F.lit(False))
        return F.coalesce(every, F.lit(False))
    if isinstance(kb, T.ArrayType):
        if not isinstance(ka, T.ArrayType):
            return F.lit(False)
        return F.coalesce(F.forall(b, lambda y: F.exists(a, lambda x: contains_all(x, ka.elementType, y, kb.elementType))), F.lit(False))
    if isinstance(kb, T.StringType) and isinstance(ka, T.StringType):
        return F.coalesce(F.contains(a, b), a.isNull() & b.isNull())
    if isinstance(ka, (T.StructType, T.ArrayType, T.StringType)) or isinstance(kb, T.StringType):
        return F.lit(False)
    return a.eqNullSafe(b)
