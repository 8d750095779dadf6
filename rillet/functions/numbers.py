"""Arithmetic, comparison and mathematics with the language's number rules, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import builtin

SMALLEST_NORMAL = 2.2250738585072014e-308
LARGEST = 1.7976931348623157e308


LOW = 0xFFFFFFFF


def _halves(x: Column) -> tuple[Column, Column]:
    """A whole number as its upper 32 bits, with the sign, and its lower 32 bits."""
    n = x.cast("long")
    return F.shiftright(n, 32), n.bitwiseAND(LOW)


def _joined(high: Column, low: Column) -> Column:
    """high * 2**32 + low, wrapping round; low, of any size, carries into high. No step overflows, so nothing is thrown and caught."""
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(LOW))


def add_long(a: Column, b: Column) -> Column:
    """Whole numbers wrap round; null is the identity."""
    (a1, a0), (b1, b0) = _halves(a), _halves(b)
    return F.coalesce(_joined(a1 + b1, a0 + b0), a.cast("long"), b.cast("long"))


def subtract_long(a: Column, b: Column) -> Column:
    """Whole numbers wrap round."""
    (a1, a0), (b1, b0) = _halves(a), _halves(b)
    return _joined(a1 - b1, a0 - b0)


def multiply_long(a: Column, b: Column) -> Column:
    """Whole numbers wrap round."""
    (a1, a0), (b1, b0) = _halves(a), _halves(b)
    upper = a0 * F.shiftright(b0, 16)  # the lower halves' product in two parts, 16 bits apart
    low = a0 * b0.bitwiseAND(0xFFFF) + F.shiftleft(upper.bitwiseAND(0xFFFF), 16)
    return _joined((a1 * b0).bitwiseAND(LOW) + (a0 * b1).bitwiseAND(LOW) + F.shiftright(upper, 16), low)


def add(a: Column, b: Column) -> Column:
    """Null is the identity of addition."""
    return F.coalesce(a + b, a, b)


def divide(a: Column, b: Column) -> Column:
    """Always a double; a zero divisor is an error, for 0 / 0 too."""
    return F.when(b == 0, F.raise_error(F.concat(a.cast("string"), F.lit(" cannot be divided because the divisor is zero"))).cast("double")).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def modulo(a: Column, b: Column) -> Column:
    """Both sides lose their fraction first; the sign is the dividend's; a NaN divisor gives the dividend."""
    whole = lambda x: F.when(F.isnan(x.cast("double")), F.lit(0)).otherwise(F.least(F.greatest(x.cast("double"), F.lit(-9.2e18)), F.lit(9.2e18))).cast("long")
    zero = F.raise_error(F.concat(a.cast("string"), F.lit(" cannot be divided because the divisor is zero"))).cast("long")
    return F.when(F.isnan(b.cast("double")), whole(a)).when(whole(b) == 0, zero).otherwise(whole(a) % whole(b))


def is_nan(x: Column) -> Column:
    """Whether a value of any type is NaN; false for null. Constant for types that have none."""
    return F.typeof(x).isin("double", "float") & F.coalesce(x.cast("string") == "NaN", F.lit(False))


def order(x: Column) -> Column:
    """A key that sorts as the language does: null, then NaN, then the other values."""
    return F.struct(F.when(x.isNull(), 0).when(is_nan(x), 1).otherwise(2).alias("rank"), x.alias("value"))


def negate(a: Column) -> Column:
    return -a


def less(a: Column, b: Column) -> Column:
    """NaN on the left is less than anything, NaN included; null comes before all numbers."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(a.isNull(), b.isNotNull()).when(b.isNull(), False).when(F.isnan(x), True).when(F.isnan(y), False).otherwise(x < y)


def equal(a: Column, b: Column) -> Column:
    """By value as doubles; NaN equals nothing; null equals null."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(~F.isnan(x) & ~F.isnan(y) & (x == y))


def number_text(x: Column) -> Column:
    """A number as JSON: whole ones without fraction, NaN as null, infinities as the largest doubles."""
    d = x.cast("double")
    shown = F.regexp_replace(F.regexp_replace(d.cast("string"), r"E(?=\d)", "e+"), "E", "e")
    plain = F.when((d == F.floor(d)) & (F.abs(d) < 9e18), F.format_string("%d", d.cast("decimal(20,0)").cast("long"))).otherwise(shown)
    return F.when(F.isnan(d), F.lit("null")).when(d == float("inf"), F.lit("1.7976931348623157e+308")).when(d == float("-inf"), F.lit("-1.7976931348623157e+308")).otherwise(plain)


def _log(f, zero: float):
    def of(x: Column) -> Column:
        d = x.cast("double")
        return F.when(F.isnan(d) | (d < zero), F.lit(float("nan"))).when(d == zero, F.lit(float("-inf"))).otherwise(f(d))

    return of


#: Logarithms of zero and below are -Infinity and NaN, not null.
log = builtin("log/0")(_log(F.ln, 0.0))
log10 = builtin("log10/0")(_log(F.log10, 0.0))
log2 = builtin("log2/0")(_log(lambda x: F.log10(x) / math.log10(2), 0.0))
log1p = builtin("log1p/0", since="1.6")(_log(F.log1p, -1.0))

#: Functions of one double whose results are doubles.
UNARY = {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x),
}
for _name, _f in UNARY.items():
    UNARY[_name] = builtin(f"{_name}/0")(lambda x, f=_f: f(x.cast("double")))
sqrt, cbrt, sin, cos, tan, sinh, cosh, tanh, asin, acos, atan, exp, exp2 = UNARY.values()


@builtin("expm1/0", since="1.6")
def expm1(x: Column) -> Column:
    return F.expm1(x.cast("double"))


@builtin("exp10/0", since="1.6")
def exp10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x.cast("double"))


@builtin("floor/0")
def floor(x: Column) -> Column:
    """A double, also for numbers beyond 64 bits, NaN and infinities."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) >= 4503599627370496.0), d).otherwise(F.floor(F.when(F.abs(d) < 4503599627370496.0, d)).cast("double"))


@builtin("round/0", since="1.6")
def round_half_away(x: Column) -> Column:
    d = x.cast("double")
    return F.signum(d) * floor(F.abs(d) + 0.5)


@builtin("pow/2")
def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


@builtin("atan2/2")
def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y.cast("double"), x.cast("double"))


@builtin("nan/0")
def nan() -> Column:
    return F.lit(float("nan"))


@builtin("infinite/0")
def infinite() -> Column:
    return F.lit(float("inf"))


@builtin("isnan/0")
def isnan(x: Column) -> Column:
    return F.coalesce(F.isnan(x.cast("double")), F.lit(False))


@builtin("isinfinite/0")
def isinfinite(x: Column) -> Column:
    return F.coalesce(F.abs(x.cast("double")) == float("inf"), F.lit(False))


@builtin("isfinite/0")
def isfinite(x: Column) -> Column:
    return ~isinfinite(x)


@builtin("isnormal/0")
def isnormal(x: Column) -> Column:
    """Zero is not normal, nor are NaN and infinities."""
    d = x.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) >= SMALLEST_NORMAL) & (F.abs(d) <= LARGEST), F.lit(False))


@builtin("tonumber/0")
def tonumber(s: Column) -> Column:
    """A string as a double; anything that isn't a number is an error."""
    got = s.try_cast("double")
    return F.when(s.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit("cannot be parsed as a number: "), s)).cast("double")).otherwise(got)
