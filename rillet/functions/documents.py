"""Documents whose shape is only known at run time: JSON text and VARIANT, and their total order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import builtin

TYPES = ("null", "boolean", "number", "string", "array", "object")


def parse(text: Column) -> Column:
    """JSON text as VARIANT; an error if it isn't JSON."""
    return F.parse_json(text)


def try_parse(text: Column) -> Column:
    """Null where the text is not JSON (`fromjson?`)."""
    return F.try_parse_json(text)


def get(doc: Column, path: str, kind: str = "variant") -> Column:
    """A place like $.a[0].b, or null."""
    return F.try_variant_get(doc, path, kind)


@builtin("type/0")
def type_of(doc: Column) -> Column:
    """One of TYPES."""
    shape = F.schema_of_variant(doc)
    return (
        F.when(doc.isNull() | F.is_variant_null(doc), "null").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object")
        .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").otherwise("number")
    )


def _is(*kinds: str):
    return lambda doc: type_of(doc).isin(*kinds)


nulls = builtin("nulls/0")(_is("null"))
booleans = builtin("booleans/0")(_is("boolean"))
numbers = builtin("numbers/0")(_is("number"))
strings = builtin("strings/0")(_is("string"))
arrays = builtin("arrays/0")(_is("array"))
objects = builtin("objects/0")(_is("object"))
iterables = builtin("iterables/0")(_is("array", "object"))
scalars = builtin("scalars/0")(_is("null", "boolean", "number", "string"))
values = builtin("values/0")(_is(*TYPES[1:]))


@builtin("finites/0")
def finites(doc: Column) -> Column:
    return numbers(doc) & F.coalesce(F.abs(F.try_variant_get(doc, "$", "double")) < float("inf"), F.lit(False))


@builtin("normals/0")
def normals(doc: Column) -> Column:
    return finites(doc) & F.coalesce(F.abs(F.try_variant_get(doc, "$", "double")) >= 2.2250738585072014e-308, F.lit(False))


@builtin("not/0")
def not_(x: Column) -> Column:
    """Only null and false are false."""
    return ~truthy(x)


def truthy(x: Column, kind: str = "boolean") -> Column:
    return F.coalesce(x, F.lit(False)) if kind == "boolean" else x.isNotNull()


def alternative(a: Column, b: Column, kind: str = "any") -> Column:
    """a // b."""
    return F.when(truthy(a, kind), a).otherwise(b)


@builtin("error/0", "error/1")
def error(message: Column | str) -> Column:
    """Raises the message; null raises nothing."""
    m = message if isinstance(message, Column) else F.lit(message)
    return F.when(m.isNotNull(), F.raise_error(m))


def order_key(doc: Column, depth: int = 3) -> Column:
    """A VARIANT as a value that Spark sorts, groups and joins in the language's total order: null, false, true, numbers,
    strings by UTF-16 unit, arrays element by element, objects by their sorted names and then their values.

    Whole numbers beyond 2**53 that are one double stay apart. Containers may be nested `depth` deep; deeper ones are an error."""
    kind = type_of(doc)
    text = F.try_variant_get(doc, "$", "string")
    number = F.when(kind == "number", F.try_variant_get(doc, "$", "double"))
    key = [
        F.when(kind == "null", 0).when(kind == "boolean", F.when(F.try_variant_get(doc, "$", "boolean"), 2).otherwise(1)).when(kind == "number", 3).when(kind == "string", 4).when(kind == "array", 5).otherwise(6).alias("rank"),
        number.alias("number"), F.when(kind == "number", F.try_variant_get(doc, "$", "decimal(38,0)")).alias("whole"), F.when(kind == "string", F.encode(text, "UTF-16BE")).alias("text"),
    ]
    if not depth:
        deep = F.raise_error(F.lit("a document is nested deeper than its order key"))
        return F.struct(*key, F.when(kind.isin("array", "object"), deep.cast("boolean")).alias("deeper"))
    inner = lambda x: order_key(x, depth - 1)
    items = F.when(kind == "array", F.try_variant_get(doc, "$", "array<variant>"))
    fields = F.when(kind == "object", F.try_variant_get(doc, "$", "map<string,variant>"))
    name = lambda n: F.encode(n, "UTF-16BE")
    # names first, then values, both in order of name
    entries = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(name(e["key"]).alias("n"), inner(e["value"]).alias("v"))))
    return F.struct(*key, F.transform(items, inner).alias("items"), F.transform(entries, lambda e: e["n"]).alias("names"), F.transform(entries, lambda e: e["v"]).alias("values"))


def try_(attempt: Column, handler: Column) -> Column:
    """try e catch h, for an attempt that gives null where it fails (`try_parse`, `try_cast`, `get`): the handler's value there."""
    return F.coalesce(attempt, handler)
