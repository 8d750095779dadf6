"""From raw documents to sampled piece ids, in five stages.

1. quality: documents that the pairwise-ranking classifier rejects go (fitted on labels that are not held out).
2. exact_dedup: of equal texts (up to white space) the one with the smallest doc_id stays.
3. near_dedup: of each group of linked near copies (five-word shingles, Jaccard 0.8 or more) the first stays.
4. mix: sources are mixed to their target weights: rows are dropped or repeated.
5. encode: each row becomes its sampled piece ids; this is the result.

Each stage takes the rows that the one before returned, as Parquet, and all but the last return the columns of
documents. Nulls, empty tables and extra columns are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillet.llm import exact_dedup, mixing, ngram_jaccard, piece_sampling, quality
from rillet.llm.common import drop, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.representatives(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "source", "lang"])


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: SQL can express neither the fitted classifier nor the sampled mix and pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
        if held is not None:
            drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
