"""String functions, as Columns. Positions and lengths count code points."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number_text
from .registry import builtin


def _lit(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _quoted(s: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


@builtin("tostring/0", "@text/0")
def tostring(x: Column, kind: str = "string") -> Column:
    """Strings as they are; numbers, booleans and null as JSON."""
    if kind == "string":
        return F.coalesce(x, F.lit("null"))
    if kind == "boolean":
        return F.coalesce(x.cast("string"), F.lit("null"))
    return F.coalesce(number_text(x), F.lit("null"))


@builtin("startswith/1")
def startswith(s: Column, prefix: Column | str) -> Column:
    return F.startswith(s, _lit(prefix))


@builtin("endswith/1")
def endswith(s: Column, suffix: Column | str) -> Column:
    return F.endswith(s, _lit(suffix))


@builtin("ltrimstr/1")
def ltrimstr(s: Column, prefix: Column | str) -> Column:
    """Without the prefix, if it is there."""
    p = _lit(prefix)
    return F.when(F.startswith(s, p), F.substr(s, F.char_length(p) + 1)).otherwise(s)


@builtin("rtrimstr/1")
def rtrimstr(s: Column, suffix: Column | str) -> Column:
    p = _lit(suffix)
    return F.when(F.endswith(s, p), F.substr(s, F.lit(1), F.char_length(s) - F.char_length(p))).otherwise(s)


@builtin("split/1")
def split(s: Column, separator: Column | str) -> Column:
    """By a literal separator; the empty one gives code points, the empty string gives no parts."""
    sep = _lit(separator)
    none = F.array().cast("array<string>")
    letters = F.filter(F.split(s, ""), lambda c: c != "")
    return F.when(s == "", none).when(sep == "", letters).otherwise(F.split(s, _quoted(sep), -1))


@builtin("join/1")
def join(parts: Column, separator: Column | str) -> Column:
    """Null parts count as empty; no parts give the empty string."""
    return F.array_join(F.transform(parts, lambda x: F.coalesce(x.cast("string"), F.lit(""))), separator) if isinstance(separator, str) else F.aggregate(
        parts, F.struct(F.lit("").alias("s"), F.lit(True).alias("first")), lambda a, x: F.struct(F.concat(a["s"], F.when(a["first"], F.lit("")).otherwise(separator), F.coalesce(x, F.lit(""))).alias("s"), F.lit(False).alias("first")))["s"]


@builtin("ascii_downcase/0")
def ascii_downcase(s: Column) -> Column:
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


@builtin("ascii_upcase/0")
def ascii_upcase(s: Column) -> Column:
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


@builtin("explode/0")
def codepoints(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)


@builtin("implode/0")
def implode(codes: Column) -> Column:
    """Each number is cut to 16 bits, a UTF-16 unit."""
    units = F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))), 4, "0"))
    return F.decode(F.unhex(F.array_join(units, "")), "UTF-16BE")


@builtin("utf8bytelength/0", since="1.6")
def utf8bytelength(s: Column) -> Column:
    return F.octet_length(s)


@builtin("length/0")
def length(s: Column) -> Column:
    """Of null, zero."""
    return F.coalesce(F.char_length(s), F.lit(0))


@builtin("indices/1")
def indices(s: Column, needle: Column | str) -> Column:
    """All places of the needle, overlapping ones too; none for the empty needle."""
    n = _lit(needle)
    none = F.array().cast("array<int>")
    last = F.char_length(s) - F.char_length(n)
    return F.when(s.isNull(), F.lit(None)).when((n == "") | (last < 0), none).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substr(s, i + 1, F.char_length(n)) == n))


@builtin("index/1")
def index(s: Column, needle: Column | str) -> Column:
    """The first place, or null."""
    n = _lit(needle)
    return F.when((n != "") & (F.position(n, s) > 0), F.position(n, s) - 1)


@builtin("rindex/1")
def rindex(s: Column, needle: Column | str) -> Column:
    n = _lit(needle)
    at = F.position(F.reverse(n), F.reverse(s))
    return F.when((n != "") & (at > 0), F.char_length(s) - at + 1 - F.char_length(n))


@builtin("contains/1")
def contains(s: Column, part: Column | str) -> Column:
    return F.contains(s, _lit(part))


@builtin("inside/1")
def inside(part: Column, s: Column | str) -> Column:
    return F.contains(_lit(s), part)


def repeat(s: Column, times: Column | float) -> Column:
    """s * n: null for n <= 0, s for n below 2, else n without its fraction."""
    n = _lit(times)
    return F.when(n <= 0, F.lit(None)).when(n < 2, s).otherwise(F.repeat(s, n.cast("int")))


def string_slice(s: Column, begin: int | None = None, end: int | None = None) -> Column:
    """s[begin:end] by code points, from the end where negative."""
    n = F.char_length(s)
    at = lambda i, default: default if i is None else F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    lo, hi = at(begin, F.lit(0)), F.least(at(end, n), n)
    return F.substr(s, lo + 1, F.greatest(hi - lo, F.lit(0)))


def interpolate(*parts: Column | str) -> Column:
    """Literal strings and columns one after the other; null shows as null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
