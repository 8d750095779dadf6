"""The pipeline, stage by stage against brute force on a small fixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillet.llm import common, mixing, quality

from .data import SCHEMA, documents
from .test_text_operators import SPACE, brute_links

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = list({r[0]: r for r in documents(9) if r[0] is not None}.values())
    rows += [(1000 + i, "LOUD!! NOISE!! " * 10 + f"X{i}!!", "en", "a", 1, *[None] * 7) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows if r[0] % 2 or r[0] < 40], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, f in corpus_pipeline.STAGES:
        docs = common.stage(f(spark, docs, folder), "test")
        out[name] = docs.collect()
        if name != "encode":
            assert docs.columns == columns
    given = spark.read.parquet(f"{folder}/documents.parquet").collect()
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    f = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", quality.features(F.col("text")).alias("f")).collect()
    good = {r["doc_id"] for r in f if float(np.dot(r["f"], model["weights"]) + model["shift"]) >= 0}
    assert sorted(r["doc_id"] for r in out["quality"]) == sorted(good)
    assert not {r["doc_id"] for r in out["quality"]} & set(range(1000, 1030))
    first = {}
    for r in sorted(out["quality"], key=lambda r: r["doc_id"]):
        first.setdefault(SPACE.sub(" ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in out["exact_dedup"]) == sorted(first.values())
    rows = [tuple(r) for r in out["exact_dedup"]]
    assert sorted(r["doc_id"] for r in out["near_dedup"]) == sorted({c for _, c, *_ in brute_links(rows)})
    near = spark.createDataFrame([tuple(r) for r in out["near_dedup"]], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r["doc_id"]: r["taken"] for r in mixing.summary(near).collect()}
    got: dict = {}
    for r in out["mix"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert sorted(r["doc_id"] for r in out["encode"]) == sorted(r["doc_id"] for r in out["mix"])
    assert len(given) > len(out["quality"]) > len(out["exact_dedup"]) > len(out["near_dedup"]) > 0


def test_run_repeats_itself(spark, folder):
    key = lambda: sorted((r["doc_id"], tuple(r["pieces"])) for r in corpus_pipeline.run(spark, folder).collect())
    assert key() == key()


def test_stages_on_odd_tables(spark, folder, tmp_path):
    """Null identifiers, rows repeated whole, extra columns with clashing names; and tables without rows."""
    rows = documents(4)
    extra = "row string, sha string, size long, id long, kept boolean, node long, __id long, n_pieces int"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + extra
    spark.createDataFrame([(*r[:5], "r", None, 5, 7, True, 1, 2, 3) for r in rows], schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 2, None) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    for name in ("odd", "none"):
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        columns, texts = docs.columns, {r["text"] for r in docs.collect()}
        for stage, f in corpus_pipeline.STAGES:
            docs = common.stage(f(spark, docs, f"{tmp_path}/{name}"), "test")
            if stage != "encode":
                assert docs.columns == columns and {r["text"] for r in docs.collect()} <= texts
        assert (docs.count() > 0) == (name == "odd")
