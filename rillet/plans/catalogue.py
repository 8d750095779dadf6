"""The registered queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import dates, formats, numbers, objects, regex, registry, strings, web
from ..functions import documents as D
from ..operators import corpus as C
from ..operators import recursion

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its own name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type = 'purchase'
GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 10""")
def flagship_top_purchasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    grouped = bought.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("sum"))
    return grouped.orderBy(F.desc("sum"), "user_id").limit(10).select("user_id", "n", F.round("sum", 2).alias("total"))



col = F.col


def record(name: str, table_name: str, sql: str, **columns) -> None:
    """A query that projects each row of a table; columns are functions of no argument, so that they need a session only when run."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, table_name).select(*[c().alias(n) for n, c in columns.items()])

    f.__name__ = name
    query(sql)(f)


# projection, iteration, construction

EVENT = T.StructType().add("user_id", "long").add("event_type", "string")


def _event():
    return F.struct("user_id", "event_type", F.struct(F.col("value").alias("amount")).alias("inner"))


record("field_access", "events", "SELECT event_id, user_id, value AS amount, CAST(NULL AS VARCHAR) AS missing FROM events",
       event_id=lambda: col("event_id"), user_id=lambda: objects.getpath(_event(), ["user_id"]), amount=lambda: objects.getpath(_event(), ["inner", "amount"]), missing=lambda: objects.at(_event(), EVENT, "none").cast("string"))
record("computed_key", "events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE role END AS v FROM (SELECT *, 'user ' || user_id AS role FROM events)",
       event_id=lambda: col("event_id"), v=lambda: objects.at(F.struct("event_type", F.concat(F.lit("user "), col("user_id")).alias("role")), T.StructType().add("event_type", "string").add("role", "string"), F.when(col("event_id") % 2 == 0, "event_type").otherwise("role")))
record("computed_object", "nation", """SELECT n_nationkey, '{"' || n_name || '":' || n_regionkey || ',"id":' || n_nationkey || '}' AS doc FROM nation""",
       n_nationkey=lambda: col("n_nationkey"), doc=lambda: formats.tojson(objects.build((col("n_name"), col("n_regionkey").cast("long")), ("id", col("n_nationkey").cast("long")))))
record("format_interpolation", "part", "SELECT p_partkey, 'q=' || replace(p_name, ' ', '%20') || '&size=' || p_size AS v FROM part",
       p_partkey=lambda: col("p_partkey"), v=lambda: formats.formatted("@uri", "q=", col("p_name"), "&size=", (col("p_size"), "int")))
record("contains_nested", "part", "SELECT p_partkey, contains(p_name, 'e') AND p_size > 25 AS v FROM part",
       p_partkey=lambda: col("p_partkey"), v=lambda: A.contains_all(F.struct(F.array(F.struct("p_name")).alias("a"), (col("p_size") > 25).alias("big")), T.StructType().add("a", T.ArrayType(T.StructType().add("p_name", "string"))).add("big", "boolean"),
           F.struct(F.array(F.struct(F.lit("e").alias("p_name"))).alias("a"), F.lit(True).alias("big")), T.StructType().add("a", T.ArrayType(T.StructType().add("p_name", "string"))).add("big", "boolean")))
record("from_entries_names", "part", "SELECT p_partkey, p_brand AS b, p_type AS t FROM part", p_partkey=lambda: col("p_partkey"),
       b=lambda: F.try_element_at(_named(), F.lit("brand")), t=lambda: F.try_element_at(_named(), F.lit("type")))
record("flatten_all", "embeddings", "SELECT vec_id, CAST(8 AS INTEGER) AS n, CAST(list_sum(embedding[1:8]) AS DOUBLE) AS total FROM embeddings", vec_id=lambda: col("vec_id"),
       n=lambda: F.size(_flat()), total=lambda: A.add(_flat()))


def _named():
    return objects.from_entries(F.array(F.struct(F.lit("brand").alias("Name"), col("p_brand").alias("Value")), F.struct(F.lit("type").alias("Name"), col("p_type").alias("Value"))), ("name",), ("value",))


def _flat():
    nested = F.array(A.nwise(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 8), 3))
    return A.flatten(nested, kind=T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))


record("index_neg", "embeddings", "SELECT vec_id, CAST(embedding[-1] AS DOUBLE) AS last, CAST(embedding[3] AS DOUBLE) AS third, CAST(NULL AS DOUBLE) AS beyond FROM embeddings",
       vec_id=lambda: col("vec_id"), last=lambda: A.index(col("embedding"), -1).cast("double"), third=lambda: A.index(col("embedding"), 2).cast("double"), beyond=lambda: A.index(col("embedding"), 64).cast("double"))
record("slice", "embeddings", "SELECT vec_id, CAST(list_sum(embedding[3:5]) AS DOUBLE) AS inner_sum, CAST(len(embedding[63:64]) AS INTEGER) AS tail FROM embeddings",
       vec_id=lambda: col("vec_id"), inner_sum=lambda: A.add(F.transform(A.slice_(col("embedding"), 2, 5), lambda x: x.cast("double"))), tail=lambda: F.size(A.slice_(col("embedding"), -2)))
record("string_slice", "documents", "SELECT doc_id, substr(text, 1, 10) AS head, right(text, 5) AS tail FROM documents",
       doc_id=lambda: col("doc_id"), head=lambda: strings.string_slice(col("text"), 0, 10), tail=lambda: strings.string_slice(col("text"), -5))
record("fromjson", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
       event_id=lambda: col("event_id"), k=lambda: formats.fromjson(col("props"), "k bigint")["k"])
record("tojson", "nation", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS doc FROM nation""",
       n_nationkey=lambda: col("n_nationkey"), doc=lambda: formats.tojson(F.struct("n_name", "n_regionkey")))
record("json_numbers", "part", """SELECT p_partkey, '{"whole":' || p_size || ',"half":' || p_size || '.5,"none":null,"big":1.7976931348623157e+308,"list":[' || p_size || ',null],"name":"' || p_name || '","ok":true}' AS doc FROM part""",
       p_partkey=lambda: col("p_partkey"), doc=lambda: formats.json_text(F.struct(col("p_size").cast("double").alias("whole"), (col("p_size") + F.lit(0.5)).alias("half"), numbers.nan().alias("none"), numbers.infinite().alias("big"),
           F.array(col("p_size").cast("double"), F.lit(None)).alias("list"), col("p_name").alias("name"), F.lit(True).alias("ok")), T.StructType().add("whole", "double").add("half", "double").add("none", "double").add("big", "double").add("list", T.ArrayType(T.DoubleType())).add("name", "string").add("ok", "boolean")))
record("interpolation", "nation", "SELECT n_nationkey, n_name || '-' || n_regionkey AS s FROM nation",
       n_nationkey=lambda: col("n_nationkey"), s=lambda: strings.interpolate(col("n_name"), "-", col("n_regionkey")))
record("concat_plus", "part", "SELECT p_partkey, p_brand || p_type AS s FROM part", p_partkey=lambda: col("p_partkey"), s=lambda: strings.interpolate(col("p_brand"), col("p_type")))
record("object_construct", "orders", "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders",
       o_orderkey=lambda: col("o_orderkey"), status=lambda: col("o_orderstatus"), price=lambda: col("o_totalprice"))
record("bind_destructure", "events", "SELECT event_id, user_id AS u, event_type AS t, CAST(NULL AS VARCHAR) AS missing FROM events",
       event_id=lambda: col("event_id"), u=lambda: _bound()["u"].cast("long"), t=lambda: _bound()["t"], missing=lambda: _bound()["missing"])


def _bound():
    """as {pair: [$u, $t, $missing]}"""
    return objects.destructure(F.struct(F.array(col("user_id").cast("string"), "event_type").alias("pair")), {"pair": ["u", "t", "missing"]})


record("alternative", "events", "SELECT event_id, CASE WHEN event_type = 'view' THEN event_type ELSE 'none' END AS t FROM events",
       event_id=lambda: col("event_id"), t=lambda: D.alternative(F.when(col("event_type") == "view", col("event_type")), F.lit("none")))
record("if_elif", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
       o_orderkey=lambda: col("o_orderkey"), band=lambda: F.when(col("o_totalprice") > 300000, "high").when(col("o_totalprice") > 100000, "mid").otherwise("low"))
record("try_catch", "part", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(-len(p_name) AS DOUBLE) AS other FROM part",
       p_partkey=lambda: col("p_partkey"), size=lambda: D.try_(col("p_size").cast("string").try_cast("double"), F.lit(-1.0)), other=lambda: D.try_(col("p_name").try_cast("double"), -F.char_length("p_name").cast("double")))
record("optional_json", "part", "SELECT p_partkey, CAST(TRY_CAST(p_size AS BIGINT) AS BIGINT) AS n FROM part",
       p_partkey=lambda: col("p_partkey"), n=lambda: D.get(D.try_parse(col("p_size").cast("string")), "$", "bigint"))
record("error_null", "region", "SELECT r_regionkey, CAST(NULL AS VARCHAR) AS e FROM region", r_regionkey=lambda: col("r_regionkey"), e=lambda: D.error(F.lit(None).cast("string")).cast("string"))


@query("SELECT event_id, value, event_type FROM events WHERE value > 50 AND NOT event_type = 'view'")
def select_and_or_not(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return C.select(e, (col("value") > 50) & D.not_(col("event_type") == "view")).select("event_id", "value", "event_type")


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def select_eq(spark, sf_dir):
    return C.select(table(spark, sf_dir, "events"), col("event_type") == "purchase").select("event_id")


@query("SELECT vec_id, CAST(place AS INTEGER) AS place, CAST(value AS DOUBLE) AS value FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS place, unnest(embedding) AS value FROM embeddings)")
def iterate_array(spark, sf_dir):
    return C.iterate(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), col("embedding"), "value", "place").select("vec_id", "place", col("value").cast("double").alias("value"))


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT n_regionkey AS k, n_name AS v FROM nation")
def comma(spark, sf_dir):
    return C.both(table(spark, sf_dir, "nation"), lambda d: d.select(col("n_nationkey").alias("k"), col("n_name").alias("v")), lambda d: d.select(col("n_regionkey").alias("k"), col("n_name").alias("v")))


@query("SELECT r_regionkey, a, b FROM region, (VALUES (1), (2)) x(a), (VALUES ('p'), ('q')) y(b)")
def object_cartesian(spark, sf_dir):
    return C.product(table(spark, sf_dir, "region").select("r_regionkey"), a=F.array(F.lit(1), F.lit(2)), b=F.array(F.lit("p"), F.lit("q")))


@query("SELECT r_regionkey FROM region WHERE 1 = 0")
def empty(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey").where(F.lit(False))


# arithmetic and comparison

L = "l_orderkey, l_linenumber"


def line(name: str, sql: str, value) -> None:
    record(name, "lineitem", f"SELECT {L}, {sql} AS v FROM lineitem", l_orderkey=lambda: col("l_orderkey"), l_linenumber=lambda: col("l_linenumber"), v=value)


line("arith_add", "l_extendedprice + l_tax", lambda: numbers.add(col("l_extendedprice"), col("l_tax")))
line("arith_sub", "CAST(l_orderkey AS BIGINT) - CAST(l_partkey AS BIGINT)", lambda: numbers.subtract_long(col("l_orderkey").cast("long"), col("l_partkey").cast("long")))
line("arith_mul", "CAST(l_orderkey AS BIGINT) * CAST(l_linenumber AS BIGINT)", lambda: numbers.multiply_long(col("l_orderkey").cast("long"), col("l_linenumber").cast("long")))
line("arith_div", "l_extendedprice / l_quantity", lambda: numbers.divide(col("l_extendedprice"), col("l_quantity")))
line("arith_mod", "CAST(trunc(l_extendedprice) AS BIGINT) % CAST(7 AS BIGINT)", lambda: numbers.modulo(col("l_extendedprice"), F.lit(7)))
line("arith_neg", "-l_quantity", lambda: numbers.negate(col("l_quantity")))
line("add_wraps", "CASE WHEN l_orderkey = 0 THEN 9223372036854775807 ELSE CAST(CAST(l_orderkey AS HUGEINT) - 9223372036854775808 - 1 AS BIGINT) END", lambda: numbers.add_long(col("l_orderkey"), F.lit(2**63 - 1)))
line("compare", "l_quantity < l_linenumber", lambda: numbers.less(col("l_quantity"), col("l_linenumber")))
line("compare_equal", "l_quantity = l_linenumber", lambda: numbers.equal(col("l_quantity"), col("l_linenumber")))
record("str_repeat", "region", "SELECT r_regionkey, repeat(r_name, 3) AS s FROM region", r_regionkey=lambda: col("r_regionkey"), s=lambda: strings.repeat(col("r_name"), 3))
record("str_divide", "pages", "SELECT page_id, CAST(len(string_split(url, '/')) AS INTEGER) AS n, string_split(url, '/')[3] AS host FROM pages",
       page_id=lambda: col("page_id"), n=lambda: F.size(strings.split(col("url"), "/")), host=lambda: A.index(strings.split(col("url"), "/"), 2))
record("array_minus", "part", "SELECT p_partkey, array_to_string([x for x in string_split(p_name, ' ') if x <> 'part' AND x <> 'red'], ' ') AS s FROM part",
       p_partkey=lambda: col("p_partkey"), s=lambda: F.array_join(A.minus(strings.split(col("p_name"), " "), F.array(F.lit("part"), F.lit("red"))), " "))
record("object_merge", "nation", """SELECT n_nationkey, '{"a":2,"b":"' || n_name || '"}' AS doc FROM nation""",
       n_nationkey=lambda: col("n_nationkey"), doc=lambda: formats.tojson(objects.merge_structs(F.struct(F.lit(1).alias("a"), col("n_name").alias("b")), T.StructType().add("a", "integer").add("b", "string"), F.struct(F.lit(2).alias("a")), T.StructType().add("a", "integer"))))
record("object_deep_merge", "nation", """SELECT n_nationkey, '{"x":{"p":' || n_regionkey || ',"q":9}}' AS doc FROM nation""",
       n_nationkey=lambda: col("n_nationkey"), doc=lambda: formats.tojson(objects.merge_structs(
           F.struct(F.struct(col("n_regionkey").alias("p"), F.lit(1).alias("q")).alias("x")), T.StructType().add("x", T.StructType().add("p", "integer").add("q", "integer")),
           F.struct(F.struct(F.lit(9).alias("q")).alias("x")), T.StructType().add("x", T.StructType().add("q", "integer")), deep=True)))


@query("""SELECT rank, doc FROM (VALUES (1, 'null'), (2, 'false'), (3, 'true'), (4, '-1.5'), (5, '2'), (6, '10'), (7, '"10"'), (8, '"2"'), (9, '[]'), (10, '[1]'), (11, '[1,2]'), (12, '{}'), (13, '{"a":1}'), (14, '{"a":2}'), (15, '{"b":0}')) t(rank, doc)""")
def cmp_total_order(spark, sf_dir):
    docs = ['{"b":0}', "10", '"2"', "[1,2]", "true", "null", '{"a":2}', "-1.5", '"10"', "[]", "2", "{}", "false", "[1]", '{"a":1}']
    rows = spark.createDataFrame([(d,) for d in docs], "doc string").withColumn("key", D.order_key(D.parse(col("doc"))))
    return rows.select("doc", F.row_number().over(Window.orderBy("key")).alias("rank"))


#: A document of mixed kinds made of an event.
MIXED = """CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END WHEN 2 THEN CAST(user_id % 7 AS VARCHAR) WHEN 3 THEN '"' || event_type || '"' WHEN 4 THEN '[' || (user_id % 3) || ']' ELSE '{"k":' || (user_id % 2) || '}' END"""


def _mixed(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("doc", F.expr(MIXED.replace("VARCHAR", "STRING")))


@query(f"SELECT doc, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first_id FROM (SELECT event_id, {MIXED} AS doc FROM events) GROUP BY doc")
def group_by_mixed(spark, sf_dir):
    rows = _mixed(spark, sf_dir).withColumn("key", D.order_key(D.parse(col("doc"))))
    return C.group_agg(rows, ["key"], doc=F.min("doc"), n=F.count("*"), first_id=F.min("event_id").cast("long")).drop("key")


@query(f"""SELECT CAST(event_id AS BIGINT) AS event_id, doc FROM (SELECT event_id, {MIXED} AS doc, event_id % 6 AS kind, user_id FROM events)
ORDER BY kind, CASE kind WHEN 1 THEN 1 - user_id % 2 WHEN 2 THEN user_id % 7 WHEN 4 THEN user_id % 3 WHEN 5 THEN user_id % 2 ELSE 0 END, doc, event_id DESC LIMIT 400""")
def sort_by_mixed(spark, sf_dir):
    rows = _mixed(spark, sf_dir).withColumn("key", D.order_key(D.parse(col("doc"))))
    return C.top_k(rows, 400, "key", F.desc("event_id")).select(col("event_id").cast("long").alias("event_id"), "doc")


#: A quantity of which some are NaN and some null, and the place that the language's order gives it.
EDGED = "CASE WHEN l_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END"
EDGED_RANK = "CASE WHEN x IS NULL THEN 0 WHEN isnan(x) THEN 1 ELSE 2 END"


def _edged(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(EDGED).alias("x"))


@query(f"""SELECT l_orderkey, l_linenumber, CAST(x AS VARCHAR) IS NULL AS empty, coalesce(isnan(x), false) AS odd FROM (SELECT l_orderkey, l_linenumber, {EDGED} AS x FROM lineitem)
ORDER BY {EDGED_RANK}, CASE WHEN isnan(x) THEN 0 ELSE x END, l_orderkey, l_linenumber LIMIT 500""")
def sort_by_nan(spark, sf_dir):
    rows = C.top_k(_edged(spark, sf_dir), 500, "x", "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", col("x").isNull().alias("empty"), numbers.is_nan(col("x")).alias("odd"))


@query(f"""SELECT l_orderkey, l_linenumber, x FROM (SELECT l_orderkey, l_linenumber, {EDGED} AS x FROM lineitem) ORDER BY {EDGED_RANK} DESC, CASE WHEN isnan(x) THEN 0 ELSE x END DESC, l_orderkey DESC, l_linenumber DESC LIMIT 1""")
def max_by_nan(spark, sf_dir):
    return C.max_by(_edged(spark, sf_dir), ["x"], ["l_orderkey", "l_linenumber"])


@query(f"""SELECT l_orderkey, l_linenumber, isnan(x) AS odd FROM (SELECT l_orderkey, l_linenumber, {EDGED} AS x FROM lineitem WHERE l_orderkey % 7 <> 0) ORDER BY {EDGED_RANK}, l_orderkey, l_linenumber LIMIT 1""")
def min_by_nan(spark, sf_dir):
    found = C.min_by(_edged(spark, sf_dir).where("l_orderkey % 7 <> 0"), ["x"], ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", F.isnan("x").alias("odd"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'NaN' ELSE CAST(list_min(embedding) = least_of AS VARCHAR) END AS least, greatest, CASE WHEN vec_id % 3 = 0 THEN 'NaN' ELSE '-' END AS first_sorted
FROM (SELECT vec_id, embedding, list_min(embedding) AS least_of, CAST(list_max(embedding) AS DOUBLE) AS greatest FROM embeddings)""")
def array_order_nan(spark, sf_dir):
    odd = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.when(col("vec_id") % 3 == 0, F.array(numbers.nan())).otherwise(F.array().cast("array<double>")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", odd.alias("a"), F.array_min("embedding").cast("double").alias("m"))
    shown = lambda x, other: F.when(F.isnan(x), "NaN").otherwise(other)
    return rows.select("vec_id", shown(A.minimum(col("a")), (A.minimum(col("a")) == col("m")).cast("string")).alias("least"), A.maximum(col("a")).alias("greatest"), shown(A.first(A.sort(col("a"))), F.lit("-")).alias("first_sorted"))


# paths and updates

record("assign_eq", "events", "SELECT event_id, user_id, CAST(0 AS DOUBLE) AS value FROM events", event_id=lambda: col("event_id"), user_id=lambda: col("user_id"),
       value=lambda: objects.setpath(F.struct("value"), ["value"], F.lit(0.0))["value"])
record("update_map", "events", "SELECT event_id, floor(value) AS value FROM events", event_id=lambda: col("event_id"), value=lambda: objects.update(F.struct("value"), ["value"], numbers.floor)["value"])
record("update_elements", "embeddings", "SELECT vec_id, list_sum([CAST(x AS DOUBLE) * 2 for x in embedding]) AS s FROM embeddings", vec_id=lambda: col("vec_id"),
       s=lambda: A.add(objects.update(F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("e")), ["e", "*"], lambda x: x * 2)["e"]))
record("arith_update", "events", "SELECT event_id, round(value + 1, 6) AS value FROM events", event_id=lambda: col("event_id"), value=lambda: F.round(objects.update(F.struct("value"), ["value"], lambda x: numbers.add(x, F.lit(1)))["value"], 6))
record("getpath", "orders", "SELECT o_orderkey, o_orderstatus AS v, CAST(NULL AS VARCHAR) AS missing FROM orders", o_orderkey=lambda: col("o_orderkey"),
       v=lambda: objects.getpath(F.struct(F.struct("o_orderstatus").alias("a")), ["a", "o_orderstatus"]), missing=lambda: objects.getpath(F.struct(F.array("o_orderstatus").alias("a")), ["a", 3]))
record("setpath", "nation", """SELECT n_nationkey, '{"a":["' || n_name || '",null,"x"]}' AS doc FROM nation""", n_nationkey=lambda: col("n_nationkey"),
       doc=lambda: formats.tojson(objects.setpath(F.struct(F.array("n_name").alias("a")), ["a", 2], F.lit("x"))))
record("del_field", "nation", """SELECT n_nationkey, '{"n_name":"' || n_name || '"}' AS doc FROM nation""", n_nationkey=lambda: col("n_nationkey"), doc=lambda: formats.tojson(objects.delpaths(F.struct("n_name", "n_regionkey"), ["n_regionkey"])))
record("delpaths", "nation", """SELECT n_nationkey, '{"a":[' || n_nationkey || ',3]}' AS doc FROM nation""", n_nationkey=lambda: col("n_nationkey"),
       doc=lambda: formats.tojson(objects.delpaths(F.struct(F.array(col("n_nationkey"), F.lit(1), F.lit(2), F.lit(3)).alias("a"), F.lit(1).alias("b")), ["a", 1], ["a", 2], ["b"])))
record("slice_assign", "embeddings", "SELECT vec_id, CAST(63 AS INTEGER) AS n, CAST(embedding[4] AS DOUBLE) AS third FROM embeddings", vec_id=lambda: col("vec_id"),
       n=lambda: F.size(A.splice(col("embedding"), 1, 3, F.array(F.lit(0.0).cast("float")))), third=lambda: A.index(A.splice(col("embedding"), 1, 3, F.array(F.lit(0.0).cast("float"))), 2).cast("double"))

NESTED = T.StructType().add("key", "long").add("inner", T.StructType().add("status", "string").add("price", "double")).add("tags", T.ArrayType(T.StringType()))


def _nested():
    return F.struct(col("o_orderkey").alias("key"), F.struct(col("o_orderstatus").alias("status"), F.floor("o_totalprice").cast("double").alias("price")).alias("inner"), F.array("o_orderpriority", "o_orderstatus").alias("tags"))


@query("""SELECT o_orderkey, path, value FROM (SELECT o_orderkey, unnest(['key', 'inner.status', 'inner.price', 'tags.0', 'tags.1']) AS path,
unnest([CAST(o_orderkey AS VARCHAR), '"' || o_orderstatus || '"', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), '"' || o_orderpriority || '"', '"' || o_orderstatus || '"']) AS value FROM orders)""")
def leaf_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.inline(objects.nodes(_nested(), NESTED, leaves=True)))


@query("""SELECT o_orderkey, path FROM (SELECT o_orderkey, unnest(['key', 'inner', 'inner.status', 'inner.price', 'tags', 'tags.0', 'tags.1']) AS path FROM orders)""")
def paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.explode(objects.nodes(_nested(), NESTED, values=False)).alias("path"))


@query("""SELECT o_orderkey, path FROM (SELECT o_orderkey, unnest(CASE WHEN o_totalprice >= 100000 THEN ['key', 'inner.price'] ELSE ['key'] END) AS path FROM orders)""")
def paths_where(spark, sf_dir):
    number = lambda x, k: F.lit(True) if isinstance(k, T.LongType) or isinstance(k, T.IntegerType) else x >= 100000 if isinstance(k, T.DoubleType) else F.lit(False)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(objects.nodes(_nested(), NESTED, where=number, values=False)).alias("path"))


@query("""SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey, unnest(range(0, 8)) FROM orders) GROUP BY o_orderkey""")
def recurse_down(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.size(objects.nodes(_nested(), NESTED)) + 1).cast("long").alias("n"))


record("walk", "orders", """SELECT o_orderkey, '{"inner":{"price":' || CAST(floor(o_totalprice) AS BIGINT) || '.0,"status":"' || lower(o_orderstatus) || '"},"key":' || o_orderkey || ',"tags":["' || lower(o_orderpriority) || '","' || lower(o_orderstatus) || '"]}' AS doc FROM orders""",
       o_orderkey=lambda: col("o_orderkey"), doc=lambda: formats.tojson(objects.walk(_nested(), NESTED, lambda x, k: strings.ascii_downcase(x) if isinstance(k, T.StringType) else x)))


def _props():
    return F.from_json("props", "map<string,bigint>")


record("to_entries", "events", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events", event_id=lambda: col("event_id"),
       key=lambda: A.index(objects.to_entries(_props()), 0)["key"], value=lambda: A.index(objects.to_entries(_props()), 0)["value"])
record("from_entries", "nation", "SELECT n_nationkey, CAST(2 AS INTEGER) AS a, n_regionkey AS b FROM nation", n_nationkey=lambda: col("n_nationkey"),
       a=lambda: _doubled()["a"], b=lambda: _doubled()["b"])


def _doubled():
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    return objects.from_entries(F.array(pair("a", F.lit(1)), pair("b", col("n_regionkey")), pair("a", F.lit(2))))


record("with_entries", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS v FROM events", event_id=lambda: col("event_id"),
       v=lambda: objects.with_entries(_props(), lambda e: F.struct(F.concat(F.lit("x_"), e["key"]).alias("key"), (e["value"] + 1).alias("value")))["x_k"])
record("map_values", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS v FROM events", event_id=lambda: col("event_id"), v=lambda: objects.map_values(_props(), lambda v: v * 2)["k"])
record("keys_has_length", "events", "SELECT event_id, 'k' AS ks, true AS has_k, false AS has_z, CAST(1 AS INTEGER) AS n FROM events", event_id=lambda: col("event_id"),
       ks=lambda: F.array_join(objects.keys(_props()), ","), has_k=lambda: objects.has(_props(), "k"), has_z=lambda: objects.in_("z", _props()), n=lambda: F.size(_props()))
record("keys_unsorted", "events", "SELECT event_id, 'k' AS ks FROM events", event_id=lambda: col("event_id"), ks=lambda: F.array_join(objects.keys_unsorted(_props()), ","))
record("variant_access", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS z FROM events", event_id=lambda: col("event_id"),
       k=lambda: D.get(D.parse(col("props")), "$.k", "bigint"), z=lambda: D.get(D.parse(col("props")), "$.z", "bigint"))


# grouping, sorting, folds


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_agg(spark, sf_dir):
    return C.group_agg(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], qty=F.round(F.sum("l_quantity"), 2), price=F.round(F.avg("l_extendedprice"), 2), n=F.count("*"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def group_collect(spark, sf_dir):
    got = C.group_collect(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.concat("role", F.lit(":"), F.char_length("text")))
    return got.select("conv_id", F.array_join("items", "|").alias("turns"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_topk(spark, sf_dir):
    return C.top_k(table(spark, sf_dir, "orders"), 20, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey")
def sort_by(spark, sf_dir):
    return C.sort_by(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "p_partkey")


@query("SELECT DISTINCT event_type, user_id FROM events")
def unique(spark, sf_dir):
    return C.unique(table(spark, sf_dir, "events").select("event_type", "user_id"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def unique_by(spark, sf_dir):
    return C.unique_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def unique_length(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 1")
def min_by(spark, sf_dir):
    return C.min_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey DESC LIMIT 1")
def max_by(spark, sf_dir):
    return C.max_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"])


@query("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders")
def min_max_length(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("*").alias("n"))


@query("SELECT round(sum(l_quantity), 2) AS total FROM lineitem")
def add_num(spark, sf_dir):
    return C.add(table(spark, sf_dir, "lineitem"), col("l_quantity")).select(F.round("total", 2).alias("total"))


@query("SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def add_str(spark, sf_dir):
    got = C.group_collect(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], col("n_name"))
    return got.select("n_regionkey", A.add(col("items"), "string").alias("names"))


@query("SELECT l_returnflag, round(sum(l_discount) / count(*), 8) AS mean, round(stddev_pop(l_discount), 8) AS sd FROM lineitem GROUP BY l_returnflag")
def avg_idiom(spark, sf_dir):
    return C.group_agg(table(spark, sf_dir, "lineitem"), ["l_returnflag"], mean=F.round(F.sum("l_discount") / F.count("*"), 8), sd=F.round(F.stddev_pop("l_discount"), 8))


@query("SELECT bool_or(l_quantity > 49) AS some, bool_and(l_quantity > 0) AS every FROM lineitem")
def any_all(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return C.any_all(rows, col("l_quantity") > 49, col("l_quantity") > 0).select(col("any").alias("some"), col("all").alias("every"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 7")
def limit(spark, sf_dir):
    return C.limit(table(spark, sf_dir, "events").select("event_id", "user_id"), 7, "event_id")


@query("(SELECT event_id FROM events ORDER BY event_id LIMIT 1) UNION ALL (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1) UNION ALL (SELECT event_id FROM events ORDER BY event_id LIMIT 1 OFFSET 5)")
def first_last_nth(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return C.both(e, lambda d: C.first(d, "event_id"), lambda d: C.last(d, "event_id"), lambda d: C.nth(d, 5, "event_id"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS running FROM events")
def foreach_running(spark, sf_dir):
    got = C.foreach(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], running=F.sum("value"))
    return got.select("user_id", "event_id", F.round("running", 4).alias("running"))


@query("SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS running FROM events")
def foreach_corpus(spark, sf_dir):
    return C.running_total(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", "user_id", 1000).select("event_id", "running")


@query("SELECT event_type, CAST(sum(user_id * user_id) AS BIGINT) AS squares FROM events GROUP BY event_type")
def reduce_sum(spark, sf_dir):
    return C.group_agg(table(spark, sf_dir, "events"), ["event_type"], squares=F.sum(col("user_id") * col("user_id")))


@query("SELECT user_id, event_id, lag(value) OVER w AS before, lead(value) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lag_lead(spark, sf_dir):
    return C.neighbours(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value").drop("value")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS chunk FROM events")
def nwise_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    numbered = C.number_rows(e, ["user_id"], ["event_id"])
    return C.chunks(numbered, ["user_id"], ["event_id"], 10).select("user_id", "event_id", col("place").cast("long").alias("place"), "chunk")


# joins and sets


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
def join_nested(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return C.join(c, o.where("o_totalprice > 200000"), col("c_custkey") == col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_lookup(spark, sf_dir):
    c = C.lookup(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), col("c_nationkey") == col("n_nationkey"))
    return C.lookup(c, table(spark, sf_dir, "region"), col("n_regionkey") == col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def semi_in(spark, sf_dir):
    return C.semi(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").where("l_quantity > 49"), col("s_suppkey") == col("l_suppkey")).select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    return C.anti(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), col("c_custkey") == col("o_custkey")).select("c_custkey")


@query("SELECT user_id, event_type FROM events WHERE event_type <> 'view'")
def anti_minus(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    return C.minus(e, e.where("event_type = 'view'"))


@query("SELECT user_id, event_type FROM events WHERE event_type = 'view'")
def intersect_bag(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    return C.intersect(e, e.where("event_type = 'view'"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
def union_all(spark, sf_dir):
    return C.plus(table(spark, sf_dir, "customer").select(col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
def union_distinct(spark, sf_dir):
    return C.unique(union_all(spark, sf_dir))


@query("SELECT e.event_id, p.p_partkey FROM events e JOIN part p ON e.event_id >= p.p_partkey * 5 AND e.event_id < p.p_partkey * 5 + 3")
def join_interval(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (col("p_partkey") * 5).alias("lo"), (col("p_partkey") * 5 + 3).alias("hi"))
    return C.interval_join(table(spark, sf_dir, "events").select("event_id"), p, "event_id", "lo", "hi", 64).select("event_id", "p_partkey")


@query("SELECT r_regionkey, a || b AS pair FROM region, (VALUES ('x'), ('y')) s(a), (VALUES ('p'), ('q'), ('r')) t(b)")
def combinations(spark, sf_dir):
    pairs = A.combinations(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("p"), F.lit("q"), F.lit("r")))
    return table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.transform(pairs, lambda p: F.array_join(p, ""))).alias("pair"))


# arrays within a row

V = "embeddings"
record("transpose", V, "SELECT vec_id, CAST(2 AS INTEGER) AS n, CAST(embedding[2] AS DOUBLE) AS x FROM embeddings", vec_id=lambda: col("vec_id"),
       n=lambda: F.size(A.transpose(F.array(A.slice_(col("embedding"), 0, 2), A.slice_(col("embedding"), 0, 1)))), x=lambda: F.get(F.get(A.transpose(F.array(A.slice_(col("embedding"), 0, 2), A.slice_(col("embedding"), 0, 1))), 1), 0).cast("double"))
record("flatten", V, "SELECT vec_id, CAST(128 AS INTEGER) AS n FROM embeddings", vec_id=lambda: col("vec_id"), n=lambda: F.size(A.flatten(F.array("embedding", "embedding"), 1)))
record("reverse", V, "SELECT vec_id, CAST(embedding[64] AS DOUBLE) AS x FROM embeddings", vec_id=lambda: col("vec_id"), x=lambda: A.first(A.reverse(col("embedding"))).cast("double"))
record("nwise", V, "SELECT vec_id, CAST(7 AS INTEGER) AS n, CAST(4 AS INTEGER) AS last FROM embeddings", vec_id=lambda: col("vec_id"), n=lambda: F.size(A.nwise(col("embedding"), 10)), last=lambda: F.size(A.last(A.nwise(col("embedding"), 10))))
record("array_sort_unique", V, "SELECT vec_id, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi, CAST(len(list_distinct(embedding)) AS INTEGER) AS n FROM embeddings", vec_id=lambda: col("vec_id"),
       lo=lambda: A.first(A.sort(col("embedding"))).cast("double"), hi=lambda: A.maximum(col("embedding")).cast("double"), n=lambda: F.size(A.unique(col("embedding"))))
record("array_by", V, "SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS least, CAST(list_min(embedding) AS DOUBLE) AS greatest FROM embeddings", vec_id=lambda: col("vec_id"),
       least=lambda: A.min_by(col("embedding"), lambda x: -x).cast("double"), greatest=lambda: A.max_by(col("embedding"), lambda x: -x).cast("double"))
record("array_group_by", "part", "SELECT p_partkey, array_to_string(list_sort(list_distinct([length(x) for x in string_split(p_name, ' ')])), ',') AS sizes FROM part", p_partkey=lambda: col("p_partkey"),
       sizes=lambda: F.array_join(F.transform(A.group_by(strings.split(col("p_name"), " "), F.char_length), lambda g: F.char_length(A.first(g)).cast("string")), ","))
record("array_unique_by", "part", "SELECT p_partkey, CAST(len(list_distinct([length(x) for x in string_split(p_name, ' ')])) AS INTEGER) AS n FROM part", p_partkey=lambda: col("p_partkey"),
       n=lambda: F.size(A.unique_by(strings.split(col("p_name"), " "), F.char_length)))
record("array_any_all", V, "SELECT vec_id, list_max(embedding) > 0.3 AS some, list_min(embedding) > -0.3 AS every FROM embeddings", vec_id=lambda: col("vec_id"),
       some=lambda: A.any_(col("embedding"), lambda x: x.cast("double") > 0.3), every=lambda: A.all_(col("embedding"), lambda x: x.cast("double") > -0.3))
record("array_select_map", V, "SELECT vec_id, CAST(len([x for x in embedding if x > 0]) AS INTEGER) AS n FROM embeddings", vec_id=lambda: col("vec_id"), n=lambda: F.size(A.map_(A.select(col("embedding"), lambda x: x > 0), lambda x: x * 2)))
record("array_add", V, "SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 8) AS s FROM embeddings", vec_id=lambda: col("vec_id"), s=lambda: F.round(A.add(F.transform("embedding", lambda x: x.cast("double"))), 8))
record("array_reduce", V, "SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) * x for x in embedding]), 6) AS s FROM embeddings", vec_id=lambda: col("vec_id"),
       s=lambda: F.round(A.reduce(col("embedding"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6))
record("array_foreach", V, "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) + embedding[2] + embedding[3], 6) AS third FROM embeddings", vec_id=lambda: col("vec_id"),
       third=lambda: F.round(A.index(A.foreach(A.limit(col("embedding"), 5), F.lit(0.0), lambda s, x: s + x.cast("double")), 2), 6))
record("array_index_of", "part", "SELECT p_partkey, CAST(1 AS INTEGER) AS at, CAST(2 AS INTEGER) AS n FROM part", p_partkey=lambda: col("p_partkey"),
       at=lambda: A.first(A.index_of(F.array(F.lit("a"), col("p_name"), F.lit("b")), F.array(col("p_name"), F.lit("b")))), n=lambda: F.size(A.indices(F.array(col("p_name"), F.lit("#"), col("p_name")), col("p_name"))))
record("array_contains", "part", "SELECT p_partkey, true AS yes, false AS no FROM part", p_partkey=lambda: col("p_partkey"),
       yes=lambda: A.contains(F.array("p_name", "p_brand"), F.array("p_brand")), no=lambda: A.contains_strings(F.array("p_name", "p_brand"), F.array(F.lit("no such thing"))))
record("array_entries", "region", "SELECT r_regionkey, CAST(1 AS INTEGER) AS key, r_name AS value FROM region", r_regionkey=lambda: col("r_regionkey"),
       key=lambda: A.last(objects.array_entries(F.array(F.lit("x"), col("r_name"))))["key"], value=lambda: A.last(objects.array_entries(F.array(F.lit("x"), col("r_name"))))["value"])
record("range_array", "region", "SELECT r_regionkey, CAST(len(range(0, r_regionkey)) AS INTEGER) AS n, CAST(coalesce(list_sum(range(r_regionkey, 10, 3)), 0) AS BIGINT) AS s FROM region", r_regionkey=lambda: col("r_regionkey"),
       n=lambda: F.size(A.range_(F.lit(0), col("r_regionkey"))), s=lambda: F.coalesce(A.add(A.range_(col("r_regionkey"), F.lit(10), 3), "long"), F.lit(0)))


# recursion


@query("SELECT CAST(2 ** i AS BIGINT) AS v, CAST(i AS INTEGER) AS level FROM range(0, 7) t(i)")
def while_loop(spark, sf_dir):
    return recursion.while_(spark.sql("SELECT CAST(1 AS BIGINT) AS v"), "v < 100", v="v * 2")


@query("SELECT CAST(128 AS BIGINT) AS v, CAST(7 AS INTEGER) AS level")
def until_loop(spark, sf_dir):
    return recursion.until(spark.sql("SELECT CAST(1 AS BIGINT) AS v"), "v > 100", v="v * 2")


@query("SELECT CAST(i AS BIGINT) AS v, CAST(i - 1 AS INTEGER) AS level FROM range(1, 10) t(i)")
def recurse_cond(spark, sf_dir):
    return recursion.recurse(spark.sql("SELECT CAST(1 AS BIGINT) AS v"), "v < 10", v="v + 1")


@query("SELECT CAST(i AS BIGINT) AS i FROM range(3, 30, 4) t(i)")
def range_rows(spark, sf_dir):
    return spark.range(3, 30, 4).select(col("id").alias("i"))


# strings

P = "p_partkey"


def part(name: str, sql: str, value) -> None:
    record(name, "part", f"SELECT {P}, {sql} AS v FROM part", p_partkey=lambda: col(P), v=value)


part("startswith", "starts_with(p_name, 'b')", lambda: strings.startswith(col("p_name"), "b"))
part("endswith", "ends_with(p_name, 'e')", lambda: strings.endswith(col("p_name"), "e"))
part("ltrimstr", "CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END", lambda: strings.ltrimstr(col("p_brand"), "Brand#"))
part("rtrimstr", "CASE WHEN ends_with(p_name, 'e') THEN left(p_name, length(p_name) - 1) ELSE p_name END", lambda: strings.rtrimstr(col("p_name"), "e"))
part("split_literal", "array_to_string(string_split(p_type, ' '), '/')", lambda: strings.join(strings.split(col("p_type"), " "), "/"))
part("split_empty", "array_to_string(string_split(p_brand, ''), '.')", lambda: strings.join(strings.split(col("p_brand"), ""), "."))
part("ascii_case", "lower(p_brand) || upper(p_name)", lambda: F.concat(strings.ascii_downcase(col("p_brand")), strings.ascii_upcase(col("p_name"))))
part("explode_codes", "CAST(list_sum([unicode(x) for x in string_split(p_name, '')]) AS BIGINT)", lambda: A.add(strings.codepoints(col("p_name")), "long"))
part("implode", "p_name", lambda: strings.implode(strings.codepoints(col("p_name"))))
part("utf8len", "CAST(octet_length(encode(p_name)) AS INTEGER)", lambda: strings.utf8bytelength(col("p_name")))
part("string_length", "CAST(length(p_name) AS INTEGER)", lambda: strings.length(col("p_name")))
part("string_index", "CAST(CASE WHEN instr(p_name, 'a') > 0 THEN instr(p_name, 'a') - 1 END AS INTEGER)", lambda: strings.index(col("p_name"), "a"))
part("string_rindex", "CAST(CASE WHEN instr(p_name, 'a') > 0 THEN length(p_name) - instr(reverse(p_name), 'a') END AS INTEGER)", lambda: strings.rindex(col("p_name"), "a"))
part("string_indices", "CAST(len(string_split(p_name, 'a')) - 1 AS INTEGER)", lambda: F.size(strings.indices(col("p_name"), "a")))
part("string_contains", "contains(p_name, 'an')", lambda: strings.contains(col("p_name"), "an"))
part("string_inside", "contains('a small part', p_type)", lambda: strings.inside(col("p_type"), "a small part"))
part("tostring", "CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END", lambda: strings.tostring(col("p_retailprice"), "number"))
part("tonumber", "CAST(p_size AS DOUBLE)", lambda: numbers.tonumber(col("p_size").cast("string")))


# regular expressions

record("re_test", "customer", "SELECT c_custkey, regexp_matches(c_name, '(?i)customer#0*[13579]+$') AS v FROM customer", c_custkey=lambda: col("c_custkey"), v=lambda: regex.test(col("c_name"), "customer#0*[13579]+$", "i"))
record("re_match", "customer", r"SELECT c_custkey, CAST(9 AS INTEGER) AS offset, regexp_extract(c_name, '\d+') AS s, regexp_extract(c_name, '\d+') AS digits FROM customer",
       c_custkey=lambda: col("c_custkey"), offset=lambda: _match()["offset"], s=lambda: _match()["string"], digits=lambda: F.get(_match()["captures"], 0)["string"])
record("re_capture", "customer", r"SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#(\d+)', 1) AS w, regexp_extract(c_name, '([A-Za-z]+)#(\d+)', 2) AS d FROM customer",
       c_custkey=lambda: col("c_custkey"), w=lambda: regex.capture(col("c_name"), r"(?<w>[A-Za-z]+)#(?<d>\d+)")["w"], d=lambda: regex.capture(col("c_name"), r"(?<w>[A-Za-z]+)#(?<d>\d+)")["d"])
record("re_scan", "pages", r"SELECT page_id, array_to_string(regexp_extract_all(url, '[a-z]+'), ',') AS v FROM pages", page_id=lambda: col("page_id"), v=lambda: F.array_join(regex.scan(col("url"), "[a-z]+"), ","))
record("re_split", "pages", r"SELECT page_id, array_to_string(string_split_regex(url, '[/?&]+'), ' ') AS v FROM pages", page_id=lambda: col("page_id"), v=lambda: F.array_join(regex.split_re(col("url"), "[/?&]+"), " "))
record("re_sub", "customer", r"SELECT c_custkey, regexp_replace(c_name, '0+', '<\0>') AS v FROM customer", c_custkey=lambda: col("c_custkey"), v=lambda: regex.sub(col("c_name"), "(?<z>0+)", "<${z}>"))
record("re_gsub", "pages", r"SELECT page_id, regexp_replace(url, '(\d)', '[\1]', 'g') AS v FROM pages", page_id=lambda: col("page_id"), v=lambda: regex.gsub(col("url"), r"(?<d>\d)", "[${d}]"))
record("re_sub_lookaround", "part", r"SELECT p_partkey, regexp_replace(p_name, '([a-z])( )([a-z])', '\1_\3') AS v FROM part", p_partkey=lambda: col("p_partkey"), v=lambda: regex.sub(col("p_name"), "(?<=[a-z]) (?=[a-z])", "_"))
record("re_capture_optional", "customer", r"SELECT c_custkey, regexp_extract(c_name, '#(\d+)', 1) AS d, NULLIF(regexp_extract(c_name, '([13579])$', 1), '') AS odd FROM customer",
       c_custkey=lambda: col("c_custkey"), d=lambda: regex.capture(col("c_name"), r"#(?<d>\d*?(?<odd>[13579])?$)")["d"], odd=lambda: regex.capture(col("c_name"), r"#(?<d>\d*?(?<odd>[13579])?$)")["odd"])
record("re_capture_all", "pages", r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '[a-z]+[.]'), lambda x: rtrim(x, '.')), ',') AS v FROM pages",
       page_id=lambda: col("page_id"), v=lambda: F.array_join(F.transform(regex.capture(col("url"), "(?<w>[a-z]+)[.]", "g"), lambda m: m["w"]), ","))
record("re_scan_groups", "pages", r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '[a-z][./?=]'), lambda x: x[2] || x[1]), ',') AS v FROM pages",
       page_id=lambda: col("page_id"), v=lambda: F.array_join(F.transform(regex.scan(col("url"), "([a-z])([./?=])"), lambda g: F.concat(g[1], g[0])), ","))
record("re_gsub_function", "part", r"SELECT p_partkey, upper(p_name[1]) || p_name[2:strpos(p_name, ' ')] || upper(p_name[strpos(p_name, ' ') + 1]) || p_name[strpos(p_name, ' ') + 2:] AS v FROM part WHERE regexp_full_match(p_name, '[a-z]+ [a-z]+')",
       p_partkey=lambda: col("p_partkey"), v=lambda: regex.gsub(col("p_name"), r"\b(?<l>[a-z])", lambda g: F.upper(g["l"])))
record("re_test_not_empty", "customer", "SELECT c_custkey, contains(c_name, '7') AS v FROM customer", c_custkey=lambda: col("c_custkey"), v=lambda: regex.test(col("c_name"), "7*", "n"))


def _match():
    return A.first(regex.match(col("c_name"), r"(?<d>\d+)"))


# formatters

record("fmt_csv", "nation", """SELECT n_nationkey, n_nationkey || ',"' || replace(n_name, '"', '""') || '",' AS v FROM nation""", n_nationkey=lambda: col("n_nationkey"),
       v=lambda: formats.csv((col("n_nationkey"), "number"), (col("n_name"), "string"), (F.lit(None).cast("double"), "number")))
record("fmt_tsv", "nation", r"""SELECT n_nationkey, n_name || chr(9) || 'a\tb' AS v FROM nation""", n_nationkey=lambda: col("n_nationkey"), v=lambda: formats.tsv((col("n_name"), "string"), (F.lit("a\tb"), "string")))
record("fmt_html", "pages", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '"', '&quot;') AS v FROM pages""", page_id=lambda: col("page_id"), v=lambda: formats.html(col("html")))
record("fmt_uri", "pages", """SELECT page_id, replace(replace(replace(replace(replace(replace(url_encode(url), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~') AS v FROM pages""", page_id=lambda: col("page_id"), v=lambda: formats.uri(col("url")))
record("fmt_sh", "nation", "SELECT n_nationkey, n_nationkey || ' ''' || n_name || ''' ''it''\\''''s''' AS v FROM nation", n_nationkey=lambda: col("n_nationkey"), v=lambda: formats.sh((col("n_nationkey"), "number"), (col("n_name"), "string"), (F.lit("it's"), "string")))
record("fmt_base64", "pages", "SELECT page_id, base64(encode(url)) AS v FROM pages", page_id=lambda: col("page_id"), v=lambda: formats.base64(col("url")))
record("fmt_base64d", "pages", "SELECT page_id, url AS v FROM pages", page_id=lambda: col("page_id"), v=lambda: formats.base64d(formats.base64(col("url"))))
record("fmt_json_numbers", "lineitem", f"SELECT {L}, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS v FROM lineitem", l_orderkey=lambda: col("l_orderkey"), l_linenumber=lambda: col("l_linenumber"), v=lambda: numbers.number_text(col("l_quantity")))


# mathematics

X = "(l_discount * 4 + 0.01)"


def maths(name: str, sql: str, f) -> None:
    line(f"math_{name}", f"round({sql}, 6)", lambda: F.round(f(col("l_discount") * 4 + 0.01), 6))


for _n in ("sqrt", "cbrt", "sin", "cos", "tan", "sinh", "cosh", "tanh", "atan", "exp"):
    maths(_n, f"{_n}({X})", numbers.UNARY[_n])
maths("asin", f"asin({X} / 2)", lambda x: numbers.asin(x / 2))
maths("acos", f"acos({X} / 2)", lambda x: numbers.acos(x / 2))
maths("exp2", f"pow(2, {X})", numbers.exp2)
maths("exp10", f"pow(10, {X})", numbers.exp10)
maths("expm1", f"exp({X}) - 1", numbers.expm1)
maths("log", f"ln({X})", numbers.log)
maths("log2", f"log2({X})", numbers.log2)
maths("log10", f"log10({X})", numbers.log10)
maths("log1p", f"ln(1 + {X})", numbers.log1p)
maths("floor", f"floor({X} * 10)", lambda x: numbers.floor(x * 10))
maths("round", f"round({X} * 10)", lambda x: numbers.round_half_away(x * 10))
maths("pow", f"pow({X}, 1.5)", lambda x: numbers.power(x, F.lit(1.5)))
maths("atan2", f"atan2({X}, 2)", lambda x: numbers.atan2(x, F.lit(2.0)))
line("math_predicates", "'false,false,true,' || CASE WHEN l_discount = 0 THEN 'false' ELSE 'true' END",
     lambda: F.concat_ws(",", *[f.cast("string") for f in (numbers.isnan(col("l_discount")), numbers.isinfinite(col("l_discount")), numbers.isfinite(col("l_discount")), numbers.isnormal(col("l_discount")))]))


@query("SELECT unnest(['nan < nan', 'nan < 1', '1 < nan', 'nan == nan', 'log 0', 'log -1', 'inf', 'null < 0']) AS k, unnest(['true', 'true', 'false', 'false', '-Infinity', 'NaN', '1.7976931348623157e+308', 'true']) AS v")
def number_edges(spark, sf_dir):
    nan, one, none = numbers.nan(), F.lit(1.0), F.lit(None).cast("double")
    found = {"nan < nan": numbers.less(nan, nan), "nan < 1": numbers.less(nan, one), "1 < nan": numbers.less(one, nan), "nan == nan": numbers.equal(nan, nan), "log 0": numbers.log(F.lit(0.0)), "log -1": numbers.log(F.lit(-1.0)), "inf": numbers.number_text(numbers.infinite()), "null < 0": numbers.less(none, F.lit(0.0))}
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in found.items()])).alias("x")).select("x.*")


# types

DOCS = ["null", "true", "1", "2.5", '"s"', "[1]", '{"a":1}', "false"]


def _docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "i int, doc string").withColumn("v", D.parse(col("doc")))


@query("SELECT CAST(i AS INTEGER) AS i, t FROM (VALUES (0, 'null'), (1, 'boolean'), (2, 'number'), (3, 'number'), (4, 'string'), (5, 'array'), (6, 'object'), (7, 'boolean')) x(i, t)")
def type_of(spark, sf_dir):
    return _docs(spark).select("i", D.type_of(col("v")).alias("t"))


@query("SELECT k, CAST(n AS BIGINT) AS n FROM (VALUES ('nulls', 1), ('booleans', 2), ('numbers', 2), ('strings', 1), ('arrays', 1), ('objects', 1), ('iterables', 2), ('scalars', 6), ('values', 7), ('finites', 2), ('normals', 2)) x(k, n)")
def selectors(spark, sf_dir):
    kinds = ("nulls", "booleans", "numbers", "strings", "arrays", "objects", "iterables", "scalars", "values", "finites", "normals")
    counts = _docs(spark).agg(*[F.count_if(getattr(D, k)(col("v"))).alias(k) for k in kinds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), col(k).alias("n")) for k in kinds])).alias("x")).select("x.*")


@query("SELECT i, value FROM (VALUES (0, '1'), (1, '[2]'), (2, '3')) x(i, value)")
def variant_iterate(spark, sf_dir):
    docs = spark.createDataFrame([('[1,[2],3]',)], "doc string").select(F.parse_json("doc").alias("v"))
    return docs.select(F.posexplode(F.col("v").cast("array<variant>")).alias("i", "x")).select("i", F.to_json("x").alias("value"))


# dates and extras

record("strftime", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS v FROM orders", o_orderkey=lambda: col("o_orderkey"), v=lambda: dates.strftime(_millis("o_orderdate"), "yyyy-MM-dd HH:mm"))
record("strftime_zone", "orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 9 HOUR, '%d.%m.%Y %H') AS v FROM orders", o_orderkey=lambda: col("o_orderkey"), v=lambda: dates.strftime(_millis("o_orderdate"), "dd.MM.yyyy HH", "Asia/Tokyo"))
record("strptime", "orders", "SELECT o_orderkey, CAST(epoch_ms(date_trunc('day', o_orderdate)) AS BIGINT) AS v FROM orders", o_orderkey=lambda: col("o_orderkey"), v=lambda: dates.strptime(dates.strftime(_millis("o_orderdate"), "yyyy-MM-dd"), "yyyy-MM-dd"))


def _millis(name: str):
    """The stored wall-clock time as epoch milliseconds, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), col(name).cast("timestamp_ntz"))


NS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
record("uuid3", "pages", f"""SELECT page_id, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS v
FROM (SELECT page_id, md5(unhex('{NS.replace("-", "")}') || encode(url)) AS h FROM pages)""", page_id=lambda: col("page_id"), v=lambda: web.uuid3(col("url"), NS))  # fmt: skip
record("uuid5", "pages", f"""SELECT page_id, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS v
FROM (SELECT page_id, sha1(unhex('{NS.replace("-", "")}') || encode(url)) AS h FROM pages)""", page_id=lambda: col("page_id"), v=lambda: web.uuid5(col("url"), NS))  # fmt: skip
record("uriparse", "pages", r"SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '//([^/:?#]*)', 1) AS host, CAST(-1 AS INTEGER) AS port, regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path FROM pages", page_id=lambda: col("page_id"),
       scheme=lambda: web.uriparse(col("url"))["scheme"], host=lambda: web.uriparse(col("url"))["host"], port=lambda: web.uriparse(col("url"))["port"], path=lambda: web.uriparse(col("url"))["path"])
record("uridecode", "pages", "SELECT page_id, url AS v FROM pages", page_id=lambda: col("page_id"), v=lambda: formats.uridecode(formats.uri(col("url"))))


@query()
def uuid4_random(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", web.uuid4().alias("id"), web.random().alias("x"))


@query()
def now_timestamp_hostname(spark, sf_dir):
    return spark.range(1).select(dates.now().alias("now"), dates.timestamp().alias("ms"), web.hostname().alias("host"))


@query()
def builtins(spark, sf_dir):
    return registry.builtins(spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
