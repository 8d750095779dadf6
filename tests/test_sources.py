import json

import pytest
from pyspark.sql import functions as F

from rillet.operators import corpus as C
from rillet.operators import recursion
from rillet.plans import modules
from rillet.sources import json_io
from rillet.streaming import records

from .conftest import DATA


def test_concatenated_values(spark, tmp_path):
    (tmp_path / "a.json").write_text('1 "two"\n{"three":\n [3]}null')
    rows = json_io.read_values(spark, str(tmp_path / "a.json")).orderBy("place").collect()
    assert [r["value"] for r in rows] == ["1", '"two"', '{"three":\n [3]}', "null"]
    assert json_io.data_file(spark, str(tmp_path / "a.json")).first()["values"][0] == "1"
    (tmp_path / "bad.json").write_text("1 {")
    with pytest.raises(Exception):
        json_io.read_values(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "empty.json").write_text(" \n")
    assert json_io.read_values(spark, str(tmp_path / "empty.json")).count() == 0


def test_lines_and_styles(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    json_io.write_json(df, str(tmp_path / "c"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "c")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    assert json_io.read_lines(spark, str(tmp_path / "c"), "a int").agg(F.sum("a")).first()[0] == 3
    assert json_io.read_lines(spark, str(tmp_path / "c")).count() == 2
    json_io.write_json(df.select("b"), str(tmp_path / "r"), "raw")
    assert "x" in {r[0] for r in spark.read.text(str(tmp_path / "r")).collect()}
    json_io.write_json(df, str(tmp_path / "p"), "pretty")
    assert json_io.null_input(spark).first()[0] is None


def test_stream_gives_what_batch_gives(spark, tmp_path):
    program = lambda d: C.select(d, F.col("value") > 50).select("event_id", (F.col("value") * 2).alias("v"))
    batch = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    rows = records.stream(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " "))
    records.run_once(records.apply(rows, program), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema("event_id long, v double").json(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(program(batch).collect())


def test_windows_on_a_stream(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    rows = records.stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, value double")
    records.run_once(records.windowed(rows, "ts", "1 day", "1 hour", [], n=F.count("*")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema("n long").json(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert 0 < got <= batch.count()


def test_modules(spark, tmp_path):
    fn = lambda body, **args: {"args": args, "returns": "double", "body": body}
    (tmp_path / "base.json").write_text(json.dumps({"functions": {"twice": fn("x * 2", x="double"), "f": fn("x", x="double")}}))
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "lib.json").write_text(json.dumps({"imports": ["base"], "functions": {"f": fn("x + 1", x="double")}}))
    (tmp_path / "loop.json").write_text(json.dumps({"imports": ["loop"]}))
    loader = modules.Loader(str(tmp_path))
    assert modules.include(spark, loader, "lib") == ["f", "twice"]
    assert modules.import_module(spark, loader, "base", "b") == ["b__f", "b__twice"]
    assert spark.sql("SELECT f(1), twice(2), b__f(1)").first()[:] == (2.0, 4.0, 1.0)
    for wrong in ("/etc/x", "../x", "a/a", "nothing", "loop"):
        with pytest.raises(modules.ModuleError):
            loader.load(wrong)


def test_recursion(spark):
    one = spark.createDataFrame([(1,), (50,)], "v int")
    assert sorted(r["v"] for r in recursion.while_(one, "v < 60", v="v * 2").collect()) == [1, 2, 4, 8, 16, 32, 50]
    assert sorted(r["v"] for r in recursion.until(one, "v > 40", v="v + 20").collect()) == [41, 50]
    assert recursion.while_(one, "v < 0", v="v").count() == 0


def test_bag_semantics(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(2,), (None,)], "x int")
    assert sorted(r[0] for r in C.minus(a, b).collect()) == [1, 1]
    assert {r[0] for r in C.intersect(a, b).collect()} == {2, None}
    assert C.all_(a.limit(0), F.col("x") > 0).first()[0] is True and C.any_(a.limit(0), F.col("x") > 0).first()[0] is False


def test_plans(spark):
    """Filters reach the scan, unused columns do not; grouping is partial before its one shuffle; top-k sorts nothing whole."""
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    text = C.top_k(C.group_agg(C.select(events, F.col("event_type") == "view"), ["user_id"], total=F.sum("value")), 5, "user_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text
    assert "partial_sum" in text and "TakeOrderedAndProject" in text and text.count("Exchange hashpartitioning") == 1


def test_module_search_metadata_and_chains(spark, tmp_path):
    import json

    f = lambda body: {"functions": {"f": {"args": {"x": "double"}, "returns": "double", "body": body}}}
    (tmp_path / "app" / "lib").mkdir(parents=True)
    (tmp_path / "app" / "main.json").write_text(json.dumps({"metadata": {"version": 2}, "imports": [{"path": "own", "search": "./lib"}, "shared"], "functions": {}}))
    (tmp_path / "app" / "lib" / "own.json").write_text(json.dumps(f("x * 10")))
    (tmp_path / "own.json").write_text(json.dumps(f("x * 99")))
    loader = modules.Loader(str(tmp_path / "app"), str(tmp_path), then=modules.Loader(given={"shared": {"functions": {"g": {"args": {"x": "double"}, "returns": "double", "body": "x + 1"}}}}))
    assert loader.metadata("main") == {"version": 2, "deps": ["own", "shared"]}
    assert set(loader.load("main")) == {"f", "g"} and loader.load("main")["f"]["body"] == "x * 10" and loader.load("own")["f"]["body"] == "x * 99"
    assert modules.include(spark, loader, "main") == ["f", "g"] and spark.sql("SELECT f(g(1))").first()[0] == 20.0
    with pytest.raises(modules.ModuleError):
        loader.load("missing")


def test_large_files_of_values_are_refused(spark, tmp_path):
    (tmp_path / "v.json").write_text("[1,\n2] 3 " * 10)
    assert json_io.read_values(spark, str(tmp_path / "v.json")).count() == 20
    with pytest.raises(Exception, match="too large"):
        json_io.read_values(spark, str(tmp_path / "v.json"), largest=20).collect()
