"""Formatters and their inverses, as Columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import number_text
from .registry import builtin


def _replaced(s: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _cell(x: Column, kind: str, text) -> Column:
    """One field: strings by `text`, numbers and booleans as JSON, null and NaN empty."""
    if kind == "string":
        shown = text(x)
    elif kind == "boolean":
        shown = x.cast("string")
    else:
        shown = F.when(~F.isnan(x.cast("double")), number_text(x))
    return F.coalesce(shown, F.lit(""))


@builtin("@csv/0")
def csv(*cells: tuple[Column, str]) -> Column:
    """Cells with their types: strings in quotes, which are doubled inside."""
    return F.concat_ws(",", *[_cell(x, k, lambda s: F.concat(F.lit('"'), _replaced(s, ('"', '""'), ("\0", "\\0")), F.lit('"'))) for x, k in cells])


@builtin("@tsv/0")
def tsv(*cells: tuple[Column, str]) -> Column:
    return F.concat_ws("\t", *[_cell(x, k, lambda s: _replaced(s, ("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))) for x, k in cells])


@builtin("@html/0")
def html(s: Column) -> Column:
    return _replaced(s, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("\0", "\\0"))


@builtin("@uri/0")
def uri(s: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and -_.!~*'() stand for themselves."""
    return _replaced(F.url_encode(s), ("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


@builtin("uridecode/0")
def uridecode(s: Column) -> Column:
    return F.url_decode(s)


@builtin("@sh/0")
def sh(*cells: tuple[Column, str]) -> Column:
    """Cells for a shell, strings in single quotes."""
    one = lambda x, k: F.concat(F.lit("'"), _replaced(x, ("'", "'\\''")), F.lit("'")) if k == "string" else F.coalesce(x.cast("string") if k == "boolean" else number_text(x), F.lit("null"))
    return F.concat_ws(" ", *[one(x, k) for x, k in cells])


@builtin("@base64/0")
def base64(s: Column) -> Column:
    """In one line, also where Spark breaks it after 76 characters."""
    return F.translate(F.base64(F.encode(s, "UTF-8")), "\r\n", "")


@builtin("@base64d/0", since="1.6")
def base64d(s: Column) -> Column:
    return F.decode(F.unbase64(s), "UTF-8")


@builtin("tojson/0", "@json/0")
def tojson(x: Column) -> Column:
    """A struct, map or array as compact JSON, null fields kept."""
    return F.to_json(x, {"ignoreNullFields": "false"})


def json_text(x: Column, kind: T.DataType) -> Column:
    """A value of a known type as compact JSON with the language's numbers: whole ones without fraction, NaN as null, infinities as the largest doubles."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), json_text(x[f.name], f.dataType)) for f in kind]
        shown = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: json_text(y, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(x), lambda e: F.concat(json_text(e["key"].cast("string"), T.StringType()), F.lit(":"), json_text(e["value"], kind.valueType)))
        shown = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        shown = x.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        shown = number_text(x)
    elif isinstance(kind, T.NumericType):
        shown = x.cast("string")
    else:
        shown = F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    return F.when(x.isNull(), F.lit("null")).otherwise(F.coalesce(shown, F.lit("null")))


@builtin("fromjson/0")
def fromjson(s: Column, schema: str) -> Column:
    """JSON text by a schema; text that is not JSON is an error."""
    return F.from_json(s, schema, {"mode": "FAILFAST"})


def formatted(fmt, *parts: Column | str | tuple[Column, str]) -> Column:
    """@fmt "...\\(e)...": literal strings as they are, columns by the formatter, one of this module's or its name. A value
    that is no string comes with its type, (column, "double"), and is shown as JSON first."""
    from . import strings

    f = globals()[fmt.lstrip("@")] if isinstance(fmt, str) else fmt
    cells = f in (csv, tsv, sh)

    def one(part) -> Column:
        if isinstance(part, str):
            return F.lit(part)
        x, kind = part if isinstance(part, tuple) else (part, "string")
        return f((x, kind)) if cells else f(strings.tostring(x, kind))

    return F.concat(*[one(p) for p in parts])
