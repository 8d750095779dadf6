"""What the operators of this subpackage share: staging in the cluster's shared folder, and bounded lookups."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key that holds more than one row in HOT_SHARE counts as hot; so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone a folder under /tmp will do."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "file:///tmp/rillet-shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


@contextmanager
def tidy(spark: SparkSession):
    """Within, Spark removes a job's shuffle files as soon as it has ended, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with tidy(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        drop_path(df.sparkSession, df.staged_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, facts: DataFrame, key: list[str], count: str, total: int, how: str | None = None) -> DataFrame:
    """rows left join facts on key, where facts[count] is the number of rows that hold the key.

    Keys that hold more than total / HOT_SHARE rows are at most HOT_SHARE, so those facts are broadcast;
    the other keys go through a shuffle join in which no key is large. total must not be less than the
    number of rows. facts must be cheap to read twice (staged). how is a join hint for the other keys ("merge": shuffle
rows and facts whatever the size of facts)."""
    value = [c for c in facts.columns if c not in key]
    hot = facts.where(F.col(count) * HOT_SHARE > total)
    cold = facts.where(F.col(count) * HOT_SHARE <= total)
    cold = cold.hint(how) if how else cold
    marked = rows.join(F.broadcast(hot.select(*key, F.struct(*value).alias("__hot"))), key, "left")
    done = marked.where(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in value])
    rest = marked.where(F.col("__hot").isNull()).drop("__hot").join(cold, key, "left").select(*rows.columns, *value)
    return done.unionByName(rest)
