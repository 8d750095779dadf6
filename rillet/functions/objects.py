"""Objects and paths: structs whose fields are known when the plan is made, and maps whose keys are not.

A path is a list of field names (strings), positions (whole numbers) and slices (pairs), as the plan knows them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .registry import builtin

Path = list


@builtin("getpath/1")
def getpath(doc: Column, path: Path) -> Column:
    """Null where anything on the way is missing."""
    for step in path:
        doc = doc[step] if isinstance(step, str) else arrays.index(doc, step) if isinstance(step, int) else arrays.slice_(doc, *step)
    return doc


@builtin("setpath/2")
def setpath(doc: Column, path: Path, value: Column) -> Column:
    """The document with the value there; short arrays are padded with null."""
    return update(doc, path, lambda _: value)


@builtin("_modify/2")
def update(doc: Column, path: Path, f: Callable[[Column], Column]) -> Column:
    """doc.path |= f, as one expression: each container is built once."""
    if not path:
        return f(doc)
    step, rest = path[0], path[1:]
    if step == "*":
        return F.transform(doc, lambda x: update(x, rest, f))
    if isinstance(step, str):
        return doc.withField(step, update(doc[step], rest, f))
    if isinstance(step, tuple):
        return arrays.splice(doc, *step, update(arrays.slice_(doc, *step), rest, f))
    at = F.lit(step) if step >= 0 else F.size(doc) + step
    top = F.greatest(F.size(doc) - 1, at)
    return F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == at, update(F.get(doc, i), rest, f)).otherwise(F.get(doc, i)))


@builtin("delpaths/1", "del/1")
def delpaths(doc: Column, *paths: Path) -> Column:
    """The document without these places; missing ones are passed over. The last in order go first, so places keep their meaning."""
    for path in sorted(paths, key=lambda p: [(isinstance(x, str), x) for x in p], reverse=True):
        *up, leaf = path
        if isinstance(leaf, str):
            doc = update(doc, up, lambda x, leaf=leaf: x.dropFields(leaf))
        elif isinstance(leaf, tuple):
            doc = update(doc, up, lambda x, leaf=leaf: arrays.splice(x, *leaf, F.slice(x, 1, 0)))
        else:
            doc = update(doc, up, lambda x, leaf=leaf: F.filter(x, lambda _, i: i != (F.lit(leaf) if leaf >= 0 else F.size(x) + leaf)))
    return doc


def destructure(doc: Column, pattern: list | dict | str) -> dict[str, Column]:
    """`as [$a, {k: $b}]`: the names in a pattern of lists (places), objects (fields) and names, each with its part of the document."""
    if isinstance(pattern, str):
        return {pattern: doc}
    parts = [(arrays.index(doc, i), p) for i, p in enumerate(pattern)] if isinstance(pattern, list) else [(doc[k], p) for k, p in pattern.items()]
    return {name: c for part, p in parts for name, c in destructure(part, p).items()}


def at(doc: Column, kind: T.DataType, key: Column | str | int | tuple) -> Column:
    """.[e]: a field, a place, a slice or the places of a sub-array, as the types of document and key say; null where it is missing."""
    if isinstance(kind, T.MapType):
        return F.try_element_at(doc, key if isinstance(key, Column) else F.lit(key))
    if isinstance(kind, T.StructType):
        if isinstance(key, Column):  # a computed name: the fields must have one type
            found = F.lit(None)
            for field in kind:
                found = F.when(key == field.name, doc[field.name]).otherwise(found)
            return found
        return doc[key] if key in kind.fieldNames() else F.lit(None)
    if isinstance(key, tuple):
        return arrays.slice_(doc, *key)
    if isinstance(key, list):
        return arrays.index_of(doc, F.array(*[F.lit(k) for k in key]))
    if isinstance(key, Column):
        return F.get(doc, F.when(key < 0, F.size(doc) + key).otherwise(key).cast("int"))
    return arrays.index(doc, key)


def build(*pairs: tuple[Column | str, Column]) -> Column:
    """{(e): v, ...}: a map with computed keys; of equal keys the last counts."""
    return from_entries(F.array(*[F.struct((k if isinstance(k, Column) else F.lit(k)).alias("key"), v.alias("value")) for k, v in pairs]))


def _json(x: Column, kind: T.DataType) -> Column:
    from .numbers import number_text

    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(x, {"ignoreNullFields": "false"})
    if isinstance(kind, T.StringType):
        return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    if isinstance(kind, T.BooleanType):
        return x.cast("string")
    return number_text(x) if isinstance(kind, T.NumericType) else F.to_json(F.array(x))


@builtin("paths/0", "paths/1", "leaf_paths/0", "recurse/0", "recurse_down/0")
def nodes(doc: Column, kind: T.DataType, leaves: bool = False, where: Callable[[Column, T.DataType], Column] | None = None, values: bool = True) -> Column:
    """All places of a document below its root in pre-order, or the scalars alone: array of (path, value), the path joined by dots and the value as JSON.

    where(value, type) keeps the places for which it is true. Without values the array holds the paths alone, and no JSON is made."""
    inner = (T.StructType, T.ArrayType)
    none = F.array().cast("array<struct<path:string,value:string>>" if values else "array<string>")

    def node(p: Column, v: Column, k: T.DataType) -> Column:
        got = F.array(F.struct(p.alias("path"), _json(v, k).alias("value")) if values else p)
        wanted = v.isNotNull() if where is None else v.isNotNull() & F.coalesce(where(v, k), F.lit(False))
        return F.when(wanted, got).otherwise(none)

    def below(x: Column, of: T.DataType, prefix: Column | None) -> list[Column]:
        name = lambda part: part if prefix is None else F.concat(prefix, F.lit("."), part)
        out = []
        if isinstance(of, T.StructType):
            for field in of:
                p = name(F.lit(field.name))
                if not (leaves and isinstance(field.dataType, inner)):
                    out.append(node(p, x[field.name], field.dataType))
                out += below(x[field.name], field.dataType, p)
        elif isinstance(of, T.ArrayType):
            each = lambda y, i: F.concat(*([] if leaves and isinstance(of.elementType, inner) else [node(name(i.cast("string")), y, of.elementType)]), *below(y, of.elementType, name(i.cast("string"))))
            out.append(F.coalesce(F.flatten(F.transform(x, each)), none))
        return out

    return F.concat(*below(doc, kind, None))


@builtin("walk/1", since="1.6")
def walk(doc: Column, kind: T.DataType, f: Callable[[Column, T.DataType], Column]) -> Column:
    """Rewritten from the leaves upwards by f(value, type); fields come out in order of their names."""
    if isinstance(kind, T.StructType):
        doc = F.struct(*[walk(doc[x.name], x.dataType, f).alias(x.name) for x in sorted(kind, key=lambda x: x.name)])
    elif isinstance(kind, T.ArrayType):
        doc = F.transform(doc, lambda x: walk(x, kind.elementType, f))
    return f(doc, kind)


@builtin("keys/0")
def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


@builtin("keys_unsorted/0")
def keys_unsorted(m: Column) -> Column:
    return F.map_keys(m)


@builtin("has/1")
def has(m: Column, key: Column | str | int) -> Column:
    """A key of a map, or a place of an array; of null, false."""
    if isinstance(key, int):
        return F.coalesce((F.lit(key) >= 0) & (F.lit(key) < F.size(m)), F.lit(False))
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


@builtin("in/1")
def in_(key: Column | str, m: Column) -> Column:
    return has(m, key)


@builtin("to_entries/0")
def to_entries(m: Column) -> Column:
    """(key, value) pairs of a map."""
    return F.map_entries(m)


def array_entries(a: Column) -> Column:
    """(key, value) pairs of an array, the key being the place."""
    return F.transform(a, lambda x, i: F.struct(i.alias("key"), x.alias("value")))


@builtin("from_entries/0")
def from_entries(entries: Column, keys: tuple[str, ...] = ("key",), values: tuple[str, ...] = ("value",)) -> Column:
    """A map of the pairs; of equal keys the last counts, at the first one's place, whatever the session says about repeated keys.

    keys and values name the fields to look in, the first that isn't null counts: ("key", "name") where pairs have both.
    Spark finds Key, Name and Value under these names too. A null key is an error."""
    key = lambda e: F.coalesce(*[e[k] for k in keys])
    named = F.transform(entries, lambda e, i: F.struct(F.coalesce(key(e), F.raise_error(F.lit("Cannot use null as object key"))).alias("k"), i.alias("i"), F.coalesce(*[e[v] for v in values]).alias("v")))
    sorted_ = lambda x: F.array_sort(x, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"]))
    edge = lambda x, step: F.filter(x, lambda e, i: ~F.coalesce(F.get(x, i + step)["k"] == e["k"], F.lit(False)))
    last = lambda x: F.zip_with(F.filter(x, lambda e, i: (i == 0) | ~F.coalesce(F.get(x, F.greatest(i - 1, F.lit(0)))["k"] == e["k"], F.lit(False))), edge(x, 1), lambda a, z: F.struct(a["i"].alias("i"), z["k"].alias("k"), z["v"].alias("v")))
    placed = F.array_sort(arrays._let(sorted_(named), last), lambda a, b: a["i"] - b["i"])
    return F.map_from_entries(F.transform(placed, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))


@builtin("with_entries/1")
def with_entries(m: Column, f: Callable[[Column], Column]) -> Column:
    """f gives a struct of key and value for each pair."""
    return from_entries(F.transform(F.map_entries(m), f))


@builtin("map_values/1")
def map_values(m: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform_values(m, lambda _, v: f(v))


def merge(a: Column, b: Column) -> Column:
    """a + b of maps: b's values count, a's order comes first."""
    return from_entries(F.concat(F.map_entries(a), F.map_entries(b)))


def merge_structs(a: Column, ka: T.StructType, b: Column, kb: T.StructType, deep: bool = False) -> Column:
    """a + b (or a * b, deep) of structs whose fields are known."""
    fa, fb = {x.name: x.dataType for x in ka}, {x.name: x.dataType for x in kb}
    both = lambda n: deep and n in fa and n in fb and isinstance(fa[n], T.StructType) and isinstance(fb[n], T.StructType)
    return F.struct(*[(merge_structs(a[n], fa[n], b[n], fb[n], True) if both(n) else b[n] if n in fb else a[n]).alias(n) for n in [*fa, *(n for n in fb if n not in fa)]])
