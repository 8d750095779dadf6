"""Exact deduplication by content sort.

Rows are range-partitioned by the first bytes of the normalised text (then its SHA-256 and the identifier, and for rows
equal in these the input partition that they come from), with splitters that Spark samples, and sorted outside memory within
each partition. Equal texts then stand next to each other; each row is compared in full with its neighbour, and the first
of a run has the smallest identifier. A run that is longer than a partition is split, so a hot text never lands in one
task; the runs at the two edges of each partition (at most two a partition) carry their text, are compared in full with
one another, and what they give is joined back by a broadcast of that table, whose size is bounded by the partitions.

A task holds no texts but a batch's: `dedup` passes on the first row of a run as soon as it is known, `decisions`, which
tells each row the length of its run, holds the identifiers and digests of the run at hand, at most a partition's.

Defined results: null text counts as empty; empty texts are equal to one another; a null identifier sorts last; of
rows with equal text and identifier exactly one stays; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, partitions, stage
from .words import giving_back

#: Leading characters of the normalised text that the range partitioning looks at before the digest.
LEAD = 24


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _runs(every: bool):
    """Sorted rows -> the first of each run, or every row, with its run's first identifier and length, whether the run touches an edge, and then its text."""

    @giving_back
    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # the run that may go on in the next batch: its rows, or the first of them
        held_n, last, first_run = 0, None, True

        def out(rows: pa.Table, begins: list[int], lengths: list[int], opening: str | None, closing: str | None):
            n, runs = rows.num_rows, len(begins)
            begin = np.asarray(begins, np.int64)
            which = np.repeat(np.arange(runs), np.diff(np.append(begin, n)))
            edge, text = np.zeros(runs, bool), [None] * n
            for at, t in ((0, opening), (-1, closing)):
                if t is not None:
                    edge[at], text[begins[at]] = True, t
            table = rows.select(["row", "sha"]).append_column("keep", pc.take(rows["id"], pa.array(begin[which])))
            table = table.append_column("n", pa.array(np.asarray(lengths, np.int64)[which])).append_column("first", pa.array(begin[which] == np.arange(n)))
            table = table.append_column("edge", pa.array(edge[which])).append_column("part", pa.array(np.full(n, part, np.int32)))
            return table.append_column("edge_text", pa.array(text, pa.string())).combine_chunks().to_batches()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text = batch.column("norm")
            same = pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
            goes_on = last is not None and text[0].as_py() == last
            starts = (np.flatnonzero(~same) + 1).tolist()
            if not goes_on:
                starts = [0, *starts]
            before, last = last, text[n - 1].as_py()
            light = pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "sha", "id")], ["row", "sha", "id"])
            if not starts:
                held_n += n
                if every:
                    held.append(light)
                continue
            ended = bool(held_n)
            lengths = ([held_n + starts[0]] if ended else []) + np.diff(starts).tolist()
            if every:
                rows = pa.Table.from_batches([*held, light.slice(0, starts[-1])])
                begins = ([0] if ended else []) + [x + held_n for x in starts[:-1]]
            else:
                rows = pa.Table.from_batches([*held, light.take(pa.array(starts[:-1], pa.int64()))])
                begins = list(range(len(lengths)))
            if lengths:
                opening = (before if ended else text[starts[0]].as_py()) if first_run else None
                yield from out(rows, begins, lengths, opening, None)
                first_run = False
            held, held_n = [light.slice(starts[-1]) if every else light.slice(starts[-1], 1)], n - starts[-1]
        if held_n:
            yield from out(pa.Table.from_batches(held), [0], [held_n], last if first_run else None, last)

    return run


def content_sort(docs: DataFrame, text: str = "text", key: str = "doc_id", every: bool = True) -> DataFrame:
    """Every row of docs (or the first of each run of a partition) as struct `row`, with keep_id, group_size, kept and text_sha256."""
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), normalised(text).alias("norm"), F.col(key).alias("id"), F.spark_partition_id().alias("origin"))
        .select("row", "id", F.substring("norm", 1, LEAD).alias("lead"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "origin")
    )  # the normalised text is made again after the shuffle, so that each text moves once
    ordered = keyed.repartitionByRange(n, "lead", "sha", F.col("id").asc_nulls_last(), "origin").sortWithinPartitions("lead", "sha", F.col("id").asc_nulls_last())
    bare = ordered.select("row", "id", "sha", normalised(f"row.{text}").alias("norm"))
    if every:  # decisions only: texts need not be kept
        bare = bare.withColumn("row", F.struct(F.col(f"row.{key}").alias(key)))
    schema = T.StructType([bare.schema["row"], bare.schema["sha"]]).add("keep", bare.schema["id"].dataType).add("n", "long").add("first", "boolean").add("edge", "boolean").add("part", "integer").add("edge_text", "string")
    found = stage(bare.mapInArrow(_runs(every), schema), "content-sort")
    edges = found.where("edge and first").select("sha", "edge_text", "keep", "n", "part")
    groups = edges.groupBy("sha", "edge_text").agg(F.min("keep").alias("g_keep"), F.sum("n").alias("g_n"), F.min("part").alias("g_part"))
    facts = edges.select("sha", "edge_text", "part").join(groups, ["sha", "edge_text"]).select("sha", "part", F.lit(True).alias("edge"), "g_keep", "g_n", "g_part").distinct()
    both = found.join(F.broadcast(facts), ["sha", "part", "edge"], "left")
    return both.select(
        "row",
        F.coalesce("g_keep", "keep").alias("keep_id"),
        F.coalesce("g_n", "n").alias("group_size"),
        (F.col("first") & F.coalesce(F.col("part") == F.col("g_part"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def decisions(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document, dropped ones too: key, keep_id, group_size, kept, text_sha256."""
    found = content_sort(docs.select(key, text), text, key)
    return found.select(F.col(f"row.{key}").alias(key), "keep_id", "group_size", "kept", "text_sha256")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns."""
    found = content_sort(docs, text, key, every=False).where("kept")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
