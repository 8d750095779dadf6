"""recurse, while and until over columns, as recursive common table expressions.

Each level is one Spark job over the rows that go on. A fold that has not ended after `most` levels is an error, as is one
whose rows of all levels together go beyond spark.sql.cteRecursionRowLimit; both can be raised."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

MOST = 1000


def _recursive(df: DataFrame, seed: str, going: str, emitted: str, step: dict[str, str], final: str, most: int) -> DataFrame:
    spark = df.sparkSession
    name = f"r{uuid.uuid4().hex}"
    df.createOrReplaceTempView(f"{name}_seed")
    try:
        columns = ", ".join(f"CAST({step.get(c, c)} AS {t}) AS {c}" for c, t in df.dtypes)
        names = ", ".join(df.columns)
        return spark.sql(f"""WITH RECURSIVE r({names}, level) MAX RECURSION LEVEL {most} AS (
            SELECT {names}, 0 FROM {name}_seed WHERE {seed}
            UNION ALL SELECT * FROM (SELECT {columns}, level + 1 FROM r WHERE {going}) AS n({names}, level) WHERE {emitted})
            SELECT * FROM r WHERE {final}""")
    finally:
        spark.catalog.dropTempView(f"{name}_seed")


def while_(df: DataFrame, condition: str, most: int = MOST, **step: str) -> DataFrame:
    """Each state while the condition holds, with its level. step: SQL of the next value of a column."""
    return _recursive(df, condition, "true", condition, step, "true", most)


def until(df: DataFrame, condition: str, most: int = MOST, **step: str) -> DataFrame:
    """The first state for which the condition holds."""
    return _recursive(df, "true", f"NOT coalesce({condition}, false)", "true", step, condition, most)


def recurse(df: DataFrame, condition: str | None = None, most: int = MOST, **step: str) -> DataFrame:
    """recurse(f; condition): the seed and every state after it that meets the condition; recurse(f), without one: every
    state until a stepped column is null."""
    going = condition or " AND ".join(f"{c} IS NOT NULL" for c in step)
    return _recursive(df, "true", "true", going, step, "true", most)
