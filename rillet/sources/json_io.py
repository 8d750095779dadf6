"""JSON in and out: whitespace-separated values, lines, data files, and compact, indented or raw text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import json_text


def _values(batches):
    """The top-level JSON values of each text, one a row."""
    decoder = json.JSONDecoder()
    for batch in batches:
        for path, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
            at, place, out = 0, 0, []
            while True:
                while at < len(text) and text[at] in " \t\r\n﻿":
                    at += 1
                if at == len(text):
                    break
                _, end = decoder.raw_decode(text, at)
                out.append((path, place, text[at:end]))
                at, place = end, place + 1
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["file", "place", "value"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["file", "place", "value"])


#: Files of values that may run over lines cannot be split; beyond this size they are refused.
LARGEST_FILE = 256 << 20


def read_values(spark: SparkSession, path: str, largest: int = LARGEST_FILE) -> DataFrame:
    """file, place, value (JSON text): all values of each file, which may stand side by side or over several lines. A file is
    read by one task, so one of more than `largest` bytes is an error: values that are a line each are for `read_lines`, in splits."""
    files = spark.read.text(path, wholetext=True)
    small = F.col("_metadata.file_size") <= largest
    refused = F.raise_error(F.concat(F.lit("too large to read as a whole, use read_lines: "), F.col("_metadata.file_path")))
    files = files.select(F.col("_metadata.file_path").alias("file"), F.when(small, F.col("value")).otherwise(refused.cast("string")).alias("value"))
    return files.mapInArrow(_values, "file string, place long, value string")


def read_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One value a line, in splits: by a schema (columns, pruned by Catalyst), else as VARIANT `doc`."""
    if schema:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("doc"))


def data_file(spark: SparkSession, path: str) -> DataFrame:
    """import "p" as $name: all values of a file as one array of JSON texts, for data small enough to be a value; larger
    data is joined as the rows of `read_values` or `read_lines`."""
    return read_values(spark, path).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "place", "value"))), lambda v: v["value"]).alias("values"))


def null_input(spark: SparkSession) -> DataFrame:
    """A single null."""
    return spark.range(1).select(F.lit(None).cast("string").alias("value"))


def compact(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def pretty(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false", "pretty": "true"})


def write_json(df: DataFrame, path: str, style: str = "compact") -> None:
    """One document a row: compact, with the language's numbers, or pretty; raw writes the strings of a single column as they are."""
    if style == "raw":
        out = df.select(F.col(df.columns[0]).cast("string").alias("value"))
    elif style == "pretty":
        out = df.select(pretty(F.struct("*")).alias("value"))
    else:
        out = df.select(json_text(F.struct("*"), df.schema).alias("value"))
    out.write.mode("overwrite").text(path)
