"""Edges that the tables do not hold: nulls, NaN, empty and astral strings, bounds, errors."""

import math
import random
from base64 import b64encode

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.functions import arrays as A
from rillet.functions import documents as D
from rillet.functions import formats, numbers, objects, regex, registry, strings, web
from rillet.operators import corpus as C


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first()["v"]


def s(x):
    return F.lit(x).cast("string")


def ints(*x):
    return F.array(*[F.lit(i) for i in x]).cast("array<int>")


@pytest.mark.parametrize(("column", "want"), [
    (lambda: strings.split(s(""), ","), []), (lambda: strings.split(s("a,b,"), ","), ["a", "b", ""]), (lambda: strings.split(s("a.b"), "."), ["a", "b"]), (lambda: strings.split(s("a\\Eb"), "\\E"), ["a", "b"]),
    (lambda: strings.split(s("aé😄"), ""), ["a", "é", "😄"]), (lambda: strings.codepoints(s("a😄")), [97, 128516]), (lambda: strings.implode(ints(97, 0x1F604)), "a"),
    (lambda: strings.indices(s("aaa"), "aa"), [0, 1]), (lambda: strings.indices(s("aaa"), ""), []), (lambda: strings.index(s("abc"), "z"), None), (lambda: strings.rindex(s("a,b,c"), ","), 3),
    (lambda: strings.repeat(s("ab"), 0), None), (lambda: strings.repeat(s("ab"), 1.9), "ab"), (lambda: strings.repeat(s("ab"), 2.9), "abab"),
    (lambda: strings.string_slice(s("héllo"), -3, -1), "ll"), (lambda: strings.string_slice(s("abc"), 2, 1), ""), (lambda: strings.string_slice(s("abc"), -9), "abc"),
    (lambda: strings.join(F.array(s("a"), s(None), s("b")), "-"), "a--b"), (lambda: strings.join(F.array().cast("array<string>"), "-"), ""), (lambda: strings.ascii_upcase(s("aé")), "Aé"),
    (lambda: strings.ltrimstr(s("xxa"), "x"), "xa"), (lambda: strings.rtrimstr(s("a"), "b"), "a"), (lambda: strings.length(s(None)), 0),
    (lambda: A.index(ints(1, 2), 5), None), (lambda: A.index(ints(1, 2), -3), None), (lambda: A.slice_(ints(1, 2, 3), -2), [2, 3]), (lambda: A.slice_(ints(1, 2, 3), 5, 9), []), (lambda: A.slice_(ints(1, 2, 3), 2, 1), []),
    (lambda: A.minus(ints(1, 2, 1, 3), ints(1)), [2, 3]), (lambda: A.minus(ints(2, 2), ints(1)), [2, 2]), (lambda: A.index_of(ints(1, 2, 1, 2), ints(1, 2)), [0, 2]), (lambda: A.index_of(ints(1), ints()), []),
    (lambda: A.range_(F.lit(0), F.lit(0)), []), (lambda: A.range_(F.lit(5), F.lit(0), -2), [5, 3, 1]), (lambda: A.range_(F.lit(0), F.lit(3), 0), []),
    (lambda: A.min_by(F.array(F.lit("bb"), F.lit("a"), F.lit("c")), F.char_length), "a"), (lambda: A.max_by(F.array(F.lit("b"), F.lit("a")), F.char_length), "a"),
    (lambda: A.group_by(ints(3, 1, 2, 5), lambda x: x % 2), [[2], [3, 1, 5]]), (lambda: A.unique_by(ints(3, 1, 2, 4), lambda x: x % 2), [2, 3]), (lambda: A.transpose(F.array(ints(1, 2), ints(3))), [[1, 3], [2, None]]),
    (lambda: A.combinations_n(ints(0, 1), 2), [[0, 0], [0, 1], [1, 0], [1, 1]]), (lambda: A.foreach(ints(1, 2, 3), F.lit(0), lambda a, x: a + x, "int"), [1, 3, 6]), (lambda: A.limit(ints(1, 2), -1), [1, 2]), (lambda: A.add(F.array().cast("array<int>")), None),
    (lambda: A.nwise(ints(1, 2, 3), 2), [[1, 2], [3]]), (lambda: A.splice(ints(1, 2, 3, 4), 1, 3, ints(9)), [1, 9, 4]),
    (lambda: numbers.modulo(F.lit(-5.9), F.lit(3)), -2), (lambda: numbers.modulo(F.lit(5), F.lit(float("nan"))), 5), (lambda: numbers.add(F.lit(None).cast("int"), F.lit(1)), 1), (lambda: numbers.add_long(F.lit(2**63 - 1), F.lit(1)), -(2**63)),
    (lambda: numbers.multiply_long(F.lit(2**62), F.lit(4)), 0), (lambda: numbers.subtract_long(F.lit(-(2**63) + 1), F.lit(5)), 2**63 - 4),
    (lambda: numbers.number_text(F.lit(1.0)), "1"), (lambda: numbers.number_text(F.lit(2.5)), "2.5"), (lambda: numbers.number_text(F.lit(float("nan"))), "null"), (lambda: numbers.number_text(F.lit(1e-7)), "1.0e-7"),
    (lambda: numbers.round_half_away(F.lit(-2.5)), -3.0), (lambda: numbers.floor(F.lit(1e300)), 1e300), (lambda: numbers.isnormal(F.lit(0.0)), False), (lambda: numbers.log10(F.lit(0)), float("-inf")), (lambda: numbers.log2(F.lit(8.0)), 3.0),
    (lambda: regex.sub(s("aXbX"), "(?<x>X)", "<${x}>"), "a<X>bX"), (lambda: regex.sub(s("aXbX"), "x", "-", "gi"), "a-b-"), (lambda: regex.sub(s("abc"), "z", "-"), "abc"), (lambda: regex.split_re(s("a, b,c"), ", *"), ["a", "b", "c"]), (lambda: regex.scan(s("a1b22"), r"\d+"), ["1", "22"]),
    (lambda: formats.html(s("<a href='x'>&\"")), "&lt;a href=&apos;x&apos;&gt;&amp;&quot;"), (lambda: formats.uri(s("ü -_.~!*'()é&")), "%C3%BC%20-_.~!*'()%C3%A9%26"), (lambda: formats.csv((s('a"b'), "string"), (F.lit(True), "boolean"), (F.lit(float("nan")), "number")), '"a""b",true,'),
    (lambda: formats.base64d(formats.base64(s("ä😄"))), "ä😄"), (lambda: web.uuid5(s("http://python.org/"), "6ba7b811-9dad-11d1-80b4-00c04fd430c8"), "4c565f0d-3f5a-5890-b41b-20cf47701c5e"), (lambda: web.uuid3(s("http://python.org/"), "6ba7b811-9dad-11d1-80b4-00c04fd430c8"), "9fe8e8c4-aaa8-32a9-a55c-4535a88b748d"),
    (lambda: objects.has(F.create_map(s("a"), F.lit(1)), "a"), True), (lambda: objects.has(ints(1), 1), False), (lambda: objects.has(F.lit(None).cast("array<int>"), 0), False),
    (lambda: formats.tojson(objects.from_entries(F.array(F.struct(s("a").alias("key"), F.lit(1).alias("value")), F.struct(s("b").alias("key"), F.lit(2).alias("value")), F.struct(s("a").alias("key"), F.lit(3).alias("value"))))), '{"a":3,"b":2}'),
    (lambda: formats.tojson(objects.merge(F.create_map(s("a"), F.lit(1), s("b"), F.lit(2)), F.create_map(s("a"), F.lit(9)))), '{"a":9,"b":2}'),
    (lambda: D.alternative(F.lit(False), F.lit(True), "boolean"), True), (lambda: D.not_(F.lit(None).cast("boolean")), True), (lambda: D.error(s(None)), None),
])
def test_value(value, column, want):
    got = value(column())
    assert got == want or isinstance(want, float) and math.isclose(got, want)


def test_long_arithmetic_wraps(spark):
    rng = random.Random(5)
    edges = [0, 1, -1, 5, 2**16, 2**31 - 1, 2**31, -(2**31), 2**32 - 1, 2**32, -(2**32), 2**62, 2**63 - 1, -(2**63), -(2**63) + 1]
    edges += [rng.randrange(-(2**63), 2**63) for _ in range(20)]
    wrap = lambda n: (n + 2**63) % 2**64 - 2**63
    rows = spark.createDataFrame([(a, b) for a in edges for b in edges], "a long, b long")
    for r in rows.select("a", "b", numbers.add_long(F.col("a"), F.col("b")).alias("add"), numbers.subtract_long(F.col("a"), F.col("b")).alias("sub"), numbers.multiply_long(F.col("a"), F.col("b")).alias("mul")).collect():
        assert (r["add"], r["sub"], r["mul"]) == (wrap(r["a"] + r["b"]), wrap(r["a"] - r["b"]), wrap(r["a"] * r["b"]))
    void = spark.createDataFrame([(None, 3), (3, None), (None, None)], "a long, b long")
    got = void.select(numbers.add_long(F.col("a"), F.col("b")), numbers.subtract_long(F.col("a"), F.col("b")), numbers.multiply_long(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(3, None, None), (3, None, None), (None, None, None)]
    for f in (numbers.add_long, numbers.subtract_long, numbers.multiply_long):  # a row that overflows costs no more than another
        plan = rows.select(f(F.col("a"), F.col("b")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert "try" not in plan and "decimal" not in plan


@pytest.mark.parametrize("text", ["", "a" * 57, "a" * 58, "ä😄" * 40, "a\r\nb" * 30])
def test_base64_is_one_line(value, text):
    encoded = formats.base64(s(text))
    assert value(encoded) == b64encode(text.encode()).decode()
    assert value(formats.base64d(encoded)) == text
    assert value(formats.base64(s(None))) is None


@pytest.mark.parametrize("column", [lambda: numbers.divide(F.lit(0), F.lit(0)), lambda: numbers.modulo(F.lit(5), F.lit(0.5)), lambda: numbers.tonumber(F.lit("x")), lambda: D.error("no"), lambda: D.parse(F.lit("{")), lambda: formats.fromjson(F.lit("{"), "a int")])
def test_errors(value, column):
    with pytest.raises(Exception):
        value(column())


def test_match_offsets_and_captures(value):
    got = value(regex.match(F.lit("😄foo bar foo"), "(?<x>f)(o+)(z)?", "g"))
    assert [(m["offset"], m["length"], m["string"]) for m in got] == [(1, 3, "foo"), (9, 3, "foo")]
    assert [(c["offset"], c["length"], c["string"], c["name"]) for c in got[0]["captures"]] == [(1, 1, "f", "x"), (2, 2, "oo", None), (-1, 0, None, None)]
    assert value(regex.match(F.lit("abc"), "z")) == []
    with pytest.raises(ValueError):
        regex.test(F.lit("a"), "a", "q")


def test_groups_of_patterns():
    assert regex._groups(r"(?<a>x)(y)?((?<b>z)|w)[(](?:(q))*(?=(p))(?<!k)(v){0,2}\(") == [("a", True), (None, False), (None, True), ("b", False), (None, False), (None, True), (None, False)]
    assert regex._groups("(?<a>x)|(?<b>y)") == [("a", False), ("b", False)] and regex._groups("[])(]x") == []


@pytest.mark.parametrize(("column", "want"), [
    (lambda: regex.sub(s("ab ab"), "(?<=a)b", "X"), "aX ab"), (lambda: regex.sub(s("ab ac"), "a(?=c)", "X"), "ab Xc"), (lambda: regex.sub(s("😄ab"), "^", "-"), "-😄ab"), (lambda: regex.sub(s("abc"), "$", "-"), "abc-"),
    (lambda: regex.sub(s("a1b2"), r"(?<l>[a-z])(?<d>\d)", "${d}\\$${l}$1"), "1$aab2"), (lambda: regex.gsub(s("a1b2"), r"(?<l>[a-z])(?<d>\d)", lambda g: F.concat(g["d"], F.upper(g["l"]))), "1A2B"),
    (lambda: regex.sub(s("a1b2"), r"(?<l>[a-z])", lambda g: F.upper(g["l"])), "A1b2"), (lambda: regex.gsub(s("xayb"), "(?<v>[ab])", lambda g: F.lit("")), "xy"), (lambda: regex.gsub(s("abc"), "z*", "-", "n"), "abc"), (lambda: regex.sub(s("abzz"), "z*", "-", "n"), "ab-"),
    (lambda: regex.gsub(s(None), "a", lambda g: F.lit("b")), None), (lambda: regex.gsub(s(""), "^", lambda g: F.lit("b")), "b"),
    (lambda: regex.capture(s("xyz"), "(?<a>x)(?<n>N)?(?<z>z)?"), ("x", None, None)), (lambda: regex.capture(s("xyz"), "(?<a>x)(?<n>N*)"), ("x", "")), (lambda: regex.capture(s("a"), "(?<a>x)"), None), (lambda: regex.capture(s("x1 y2"), r"(?<l>\w)(?<d>\d)", "g"), [("x", "1"), ("y", "2")]),
    (lambda: regex.scan(s("a1b2"), "([a-z])([0-9])"), [["a", "1"], ["b", "2"]]), (lambda: regex.scan(s("a1b"), "([a-z])([0-9])?"), [["a", "1"], ["b", None]]), (lambda: regex.scan(s("axb"), "x*", "n"), ["x"]), (lambda: regex.scan(s("a1"), "([a-z])([0-9])", group=2), ["1"]),
    (lambda: regex.test(s("abc"), "z*", "n"), False), (lambda: regex.test(s("abz"), "z*", "n"), True), (lambda: regex.split_re(s("axxb"), "x*", "n"), ["a", "b"]), (lambda: regex.split_re(s("abc"), "z*", "n"), ["abc"]),
])
def test_regex(value, column, want):
    got = value(column())
    plain = lambda x: tuple(x) if hasattr(x, "asDict") else [plain(y) for y in x] if isinstance(x, list) else x
    assert plain(got) == want


def test_updates_and_deletions(value):
    doc = F.struct(F.struct(F.lit(1).alias("x"), ints(1, 2, 3).alias("l")).alias("a"), F.lit("q").alias("b"))
    assert value(formats.tojson(objects.setpath(doc, ["a", "l", 4], F.lit(9)))) == '{"a":{"x":1,"l":[1,2,3,null,9]},"b":"q"}'
    assert value(formats.tojson(objects.update(doc, ["a", "l", -1], lambda v: v * 10))) == '{"a":{"x":1,"l":[1,2,30]},"b":"q"}'
    assert value(formats.tojson(objects.delpaths(doc, ["a", "l", 0], ["a", "l", 2], ["b"]))) == '{"a":{"x":1,"l":[2]}}'
    assert value(objects.getpath(doc, ["a", "l", (1, 3)])) == [2, 3]


def test_collation_is_the_total_order(spark):
    rng = random.Random(3)

    def doc(depth):
        kind = rng.choice("nbissa" + "o" * (depth > 0))
        if kind == "n":
            return None
        if kind == "b":
            return rng.random() < 0.5
        if kind == "i":
            return rng.choice([-2, -0.5, 0, 1, 1.5, 1e300, 2**53])
        if kind == "s":
            return rng.choice(["", "a", "ab", "\0", "\0a", "￿", "😄"])
        if kind == "a":
            return [doc(depth - 1) for _ in range(rng.randrange(3))] if depth else []
        return {k: doc(depth - 1) for k in rng.sample(["a", "b", "ab"], rng.randrange(3))}

    def rank(x):
        return 0 if x is None else 1 if x is False else 2 if x is True else 3 if isinstance(x, (int, float)) else 4 if isinstance(x, str) else 5 if isinstance(x, list) else 6

    def compare(a, b):
        if rank(a) != rank(b):
            return rank(a) - rank(b)
        if rank(a) < 3:
            return 0
        if rank(a) == 3:
            return (float(a) > float(b)) - (float(a) < float(b))
        if rank(a) == 4:
            x, y = a.encode("utf-16-be"), b.encode("utf-16-be")
            return (x > y) - (x < y)
        if rank(a) == 6:
            order = lambda o: sorted(o, key=lambda k: k.encode("utf-16-be"))
            return compare(order(a), order(b)) or next((c for k in order(a) if (c := compare(a[k], b[k]))), 0)
        return next((c for p, q in zip(a, b) if (c := compare(p, q))), len(a) - len(b))

    docs = [doc(2) for _ in range(300)]
    import json

    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, d string").select("i", F.dense_rank().over(Window.orderBy(D.order_key(D.parse(F.col("d")), 2))).alias("k")).collect()
    keys = {r["i"]: r["k"] for r in rows}
    for _ in range(20000):
        i, j = rng.randrange(300), rng.randrange(300)
        c = compare(docs[i], docs[j])
        assert (keys[i] < keys[j]) == (c < 0) and (keys[i] == keys[j]) == (c == 0), (docs[i], docs[j])
    big = spark.createDataFrame([("9007199254740993",), ("9007199254740992",), ("9007199254740992.0",), ("1.0",), ("1",)], "d string")
    assert big.select(D.order_key(D.parse(F.col("d"))).alias("k")).distinct().count() == 3
    with pytest.raises(Exception):
        spark.range(1).select(D.order_key(D.parse(F.lit("[[1]]")), 0)).collect()


def test_levels():
    assert "round/0" in registry.names("1.6") and "round/0" not in registry.names("1.5")
    registry.define("twice/0", lambda x: x * 2)
    assert registry.find("twice/0")(4) == 8
    with pytest.raises(KeyError):
        registry.find("nothing/0")
    with pytest.raises(ValueError):
        registry.find("round/0", "2.0")


def test_walk_sorts_fields(value):
    kind = T.StructType().add("b", "integer").add("a", T.ArrayType(T.IntegerType()))
    doc = F.struct(F.lit(1).alias("b"), ints(1, 2).alias("a"))
    assert value(formats.tojson(objects.walk(doc, kind, lambda x, k: x + 1 if isinstance(k, T.IntegerType) else x))) == '{"a":[2,3],"b":2}'


def test_order_of_odd_values(spark, value):
    nan = float("nan")
    doubles = lambda *x: F.array(*[F.lit(y) for y in x]).cast("array<double>")
    a = doubles(2.0, nan, None, 1.0, nan)
    assert str(value(A.sort(a))) == "[None, nan, nan, 1.0, 2.0]" and value(A.maximum(a)) == 2.0 and value(A.minimum(a)) is None and math.isnan(value(A.minimum(doubles(3.0, nan))))
    assert str(value(A.unique(a))) == "[None, nan, 1.0, 2.0]" and value(A.max_by(doubles(1.0, nan), lambda x: x)) == 1.0 and math.isnan(value(A.min_by(doubles(1.0, nan), lambda x: x)))
    assert str(value(A.group_by(a, lambda x: x))) == "[[None], [nan, nan], [1.0], [2.0]]" and value(A.group_by(F.array().cast("array<int>"), lambda x: x)) == []
    rows = spark.createDataFrame([(1, nan), (2, None), (3, 1.0), (4, 2.0), (5, nan)], "i int, x double")
    assert [r["i"] for r in C.sort_by(rows, "x", "i").collect()] == [2, 1, 5, 3, 4]
    assert C.max_by(rows, ["x"], ["i"]).first()["i"] == 4 and C.min_by(rows.where("x is not null"), ["x"], ["i"]).first()["i"] == 1
    assert C.last(rows, "i").first()["i"] == 5 and C.last(rows.where("i > 9"), "i").first()["i"] is None
    lists = spark.createDataFrame([(1, [1, 2]), (2, None)], "i int, a array<int>")
    assert C.iterate(lists, F.col("a"), optional=True).count() == 2
    with pytest.raises(Exception):
        C.iterate(lists, F.col("a")).collect()


def test_running_total_of_several_levels(spark):
    rows = spark.range(1000).select((F.col("id") * 3).alias("i"), (F.col("id") % 7).alias("v"))
    got = {r["i"]: r["running"] for r in C.running_total(rows, "i", "v", 5).collect()}
    total = 0
    for k in range(1000):
        total += k % 7
        assert got[3 * k] == total


def test_entries_paths_and_containment(value):
    pair = lambda **k: F.struct(*[F.lit(v).cast("string").alias(n) for n, v in k.items()])
    entries = F.array(pair(key="b", Name=None, value="1"), pair(key=None, Name="a", value="2"), pair(key=None, Name="b", value="3"), pair(key="c", Name=None, value=None))
    assert value(formats.tojson(objects.from_entries(entries, ("key", "name")))) == '{"b":"3","a":"2","c":null}'
    assert value(formats.tojson(objects.from_entries(F.array(pair(Name="a", Value="2")), ("name",)))) == '{"a":"2"}'
    with pytest.raises(Exception):
        value(objects.from_entries(F.array(pair(key=None, value="1"))))
    assert value(formats.tojson(objects.build((F.concat(F.lit("x"), F.lit("y")), F.lit(1)), ("z", F.lit(2)), ("xy", F.lit(3))))) == '{"xy":3,"z":2}'
    kind = T.StructType().add("a", "integer").add("b", T.ArrayType(T.StructType().add("c", "string")))
    doc = F.struct(F.lit(1).alias("a"), F.array(F.struct(s("hello").alias("c")), F.struct(s(None).alias("c"))).alias("b"))
    assert value(objects.nodes(doc, kind, values=False)) == ["a", "b", "b.0", "b.0.c", "b.1"]
    assert value(objects.nodes(doc, kind, where=lambda x, k: F.lit(isinstance(k, T.StringType)), values=False)) == ["b.0.c"]
    part = T.StructType().add("b", T.ArrayType(T.StructType().add("c", "string")))
    holds = lambda x, k=part: value(A.contains_all(doc, kind, x, k))
    assert holds(F.struct(F.array(F.struct(s("ell").alias("c"))).alias("b"))) and not holds(F.struct(F.array(F.struct(s("z").alias("c"))).alias("b")))
    assert not holds(F.struct(F.lit(1).alias("q")), T.StructType().add("q", "integer")) and holds(F.struct(F.lit(1).alias("a")), T.StructType().add("a", "integer"))
    names = objects.destructure(doc, {"a": "x", "b": ["y", {"c": "z"}]})
    assert set(names) == {"x", "y", "z"} and value(names["x"]) == 1 and value(names["y"])["c"] == "hello" and value(names["z"]) is None
    assert value(objects.at(doc, kind, "a")) == 1 and value(objects.at(doc["b"], kind["b"].dataType, F.lit(-2)))["c"] == "hello" and value(objects.at(doc, kind, "none")) is None
    assert value(objects.at(F.create_map(s("k"), F.lit(1)), T.MapType(T.StringType(), T.IntegerType()), s("k"))) == 1
    assert value(A.flatten(F.array(F.array(ints(1), ints(2, 3))), kind=T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))) == [1, 2, 3]
    assert value(formats.formatted("uri", "?q=", s("a b"), "&n=", (F.lit(2.5), "double"))) == "?q=a%20b&n=2.5" and value(formats.formatted("@csv", "x:", (s('a"b'), "string"))) == 'x:"a""b"'
    assert value(D.try_(s("x").try_cast("double"), F.lit(-1.0))) == -1.0


def test_recursion_limits(spark):
    from rillet.operators import recursion

    before = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    one = spark.sql("SELECT CAST(1 AS BIGINT) AS v")
    assert recursion.recurse(one, None, 60, v="nullif(v + 1, 6)").count() == 5
    assert recursion.until(one, "v >= 1500", 2000, v="v + 1").first()["v"] == 1500
    with pytest.raises(Exception):
        recursion.while_(one, "v < 100", 20, v="v + 1").collect()
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit") == before
