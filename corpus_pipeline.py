"""A training corpus from `documents`: five stages, each of which works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents (the last: tokens). Each result is written as Parquet and read again.
Rows with null or empty texts and null ids pass the filters; tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontam, lshjoin, substring, toxicity
from quern.llm._spark import crc32_mod, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels of the learning part, does not reject."""
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), crc32_mod(F.col("doc_id"), 3) != 1)
    return toxicity.score_toxicity(docs.withColumnRenamed("score", "_own") if "score" in docs.columns else docs, model).where(F.col("score") < toxicity.REJECT).select(
        *(F.col("_own").alias("score") if c == "score" else F.col(c) for c in docs.columns)
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id."""
    return lshjoin.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; those of which nothing is left go."""
    return substring.without_repeats(docs, substring.passages(docs.select("doc_id", "text")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    clashes = {c: f"_own_{c}" for c in ("n_words", "n_hit", "hit_items", "hit_spans") if c in docs.columns}
    found = decontam.decontaminate(docs.withColumnsRenamed(clashes), read(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*(F.col(clashes.get(c, c)).alias(c) for c in docs.columns))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: what a trainer reads. The ids are decoded again, and a text that does not come back fails the stage."""
    import public_tokenizers

    coded = bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    checked = F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a text does not survive encoding and decoding")).cast("long"))
    return coded.select("doc_id", checked.alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("tokens", encode_tokens),
]

#: A fitted classifier decides the first stage, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
