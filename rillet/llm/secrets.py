"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are spans found by pattern alone. The linking adds weak kinds: an access identifier
of another issuer (id), an opaque string that may be a secret key (key) and an endpoint (endpoint). Each is an
interval of code points; within a scope of SCOPE code points to either side they are joined with the complementary
parts, and a weak candidate is reported only if one stands there: a key needs an identifier or an endpoint, an
identifier a key, an endpoint both an identifier and a key. The interval join is a sweep over a document's intervals in
order and one back, which give each the nearest part of each role before and after it; neither pairs nor a shuffle
arise. Places and sweeps are running sums and maxima by doubling, so n matches take time in proportion to n log n.
A weak candidate that lies wholly within a base span is left out; one that only overlaps a base span is reported beside it.

Defined results: null text counts as empty and has no spans; rows are kept as they are, repeated or with a null
identifier; an empty table gives an empty result; other columns are left out by `scan`, kept by `with_spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 16 or 32 characters at least; a run starts where the shorter pattern would start, so the others drop out.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WEAK_ID = r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|AGPA|ANPA)[A-Z0-9]{12,}"
#: Of any length, with a digit, a capital and a small letter anywhere; the possessive runs take time in proportion to it.
WEAK_KEY = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=])"
WEAK_ENDPOINT = r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}"
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
BASE = 3
SCOPE = 400

SPAN = "struct<s:int,e:int,k:int>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, join) -> Column:
    """For each place of an array, join over all values up to it (join is associative): each round reaches twice as far."""
    reach = lambda r: F.call_function("shiftleft", F.lit(1), r)
    step = lambda done, r: F.transform(done, lambda x, i: F.when(i >= reach(r), join(F.get(done, i - reach(r)), x)).otherwise(x))
    rounds = lambda v: F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return _let(values, lambda v: F.aggregate(rounds(v), v, step))


def _spans(text: Column, pattern: str, kind: int, smallest_group: int = 0) -> Column:
    """Spans of all matches: the texts between matches and the matches themselves take turns, so their lengths give the places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if smallest_group else F.lit(None)
    size = lambda x: F.transform(x, F.char_length)
    found = F.struct(size(F.split(text, pattern, -1)).alias("b"), size(matches).alias("m"), size(groups).alias("g") if smallest_group else groups.alias("g"))

    def placed(f: Column) -> Column:
        ends = _running(F.zip_with(F.slice(f["b"], 1, F.size(f["m"])), f["m"], lambda b, m: b + m), lambda x, y: x + y)
        spans = F.zip_with(ends, f["m"], lambda e, m: F.struct((e - m).alias("s"), e.alias("e"), F.lit(kind).alias("k")))
        if not smallest_group:
            return spans
        return F.transform(F.filter(F.arrays_zip(spans.alias("x"), f["g"].alias("g")), lambda y: y["g"] >= smallest_group), lambda y: y["x"])

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(found, placed).cast(f"array<{SPAN}>")).otherwise(none)


def _ends(x: Column) -> Column:
    """The end of an interval under its role: an identifier, key, endpoint, and under b if it is a base span."""
    role = lambda *kinds: F.when(x["k"].isin(*kinds), x["e"])
    return F.struct(role(1, 3).alias("i"), role(0, 2, 4).alias("c"), role(5).alias("p"), role(*range(BASE)).alias("b"))


def _starts(x: Column) -> Column:
    role = lambda *kinds: F.when(x["k"].isin(*kinds), x["s"])
    return F.struct(role(1, 3).alias("i"), role(0, 2, 4).alias("c"), role(5).alias("p"))


def _linked(parts: Column) -> Column:
    """Of intervals in order of start and kind the weak ones whose complementary parts stand in their scope, and that no base span covers."""
    nothing = F.lit(None).cast("struct<i:int,c:int,p:int,b:int>")
    furthest = _running(F.transform(parts, _ends), lambda a, x: F.struct(*[F.greatest(a[f], x[f]).alias(f) for f in "icpb"]))
    nearest = F.reverse(_running(F.transform(F.reverse(parts), _starts), lambda a, x: F.struct(*[F.least(a[f], x[f]).alias(f) for f in "icp"])))

    def keep(y: Column) -> Column:
        x, before, after = y["x"], y["before"], y["after"]
        near = lambda f: F.coalesce(x["s"] - before[f] <= SCOPE, F.lit(False)) | F.coalesce(after[f] - x["e"] <= SCOPE, F.lit(False))
        paired = ((x["k"] == 3) & near("c")) | ((x["k"] == 4) & (near("i") | near("p"))) | ((x["k"] == 5) & near("i") & near("c"))
        return x.isNotNull() & paired & ~F.coalesce(before["b"] >= x["e"], F.lit(False))  # base spans that start where a weak one does come before it

    zipped = F.arrays_zip(parts.alias("x"), F.concat(F.array(nothing), furthest).alias("before"), F.slice(nearest, 2, F.size(parts)).alias("after"))
    return F.transform(F.filter(zipped, keep), lambda y: y["x"])


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __base and __spans: arrays of (s, e, k), start, end and kind, in order of start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    order = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    found = docs.withColumns({
        "__assign": _spans(t, ASSIGN, 0, 8), "__access": _spans(t, ACCESS, 1), "__hex": _spans(t, HEX, 2),
        "__weak": F.concat(_spans(t, WEAK_ID, 3), _spans(t, WEAK_KEY, 4), _spans(t, WEAK_ENDPOINT, 5)),
    })
    found = found.withColumn("__base", order(F.concat("__assign", "__access", "__hex")))
    found = found.withColumn("__parts", order(F.concat("__base", "__weak")))
    weak = F.when(F.size("__weak") > 0, _linked(F.col("__parts"))).otherwise(F.array().cast(f"array<{SPAN}>"))
    return found.withColumn("__spans", order(F.concat("__base", weak)))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, counts of the base kinds, a digest of the base spans and all spans as text."""
    found = with_spans(docs.select(key, text), text)
    count = lambda c: F.size(c).cast("long")
    return found.select(
        key, count("__assign").alias("n_assign"), count("__access").alias("n_access"), count("__hex").alias("n_hex"),
        F.sha2(_text_of(F.col("__base")), 256).alias("base_sha256"), _text_of(F.col("__spans")).alias("spans"),
    )
