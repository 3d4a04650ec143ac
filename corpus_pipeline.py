"""A corpus pipeline: toxicity, line dedup, near-dedup, personal data, packing, each stage's table written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import line_dedup, packing, pii, setsketch, toxicity
from quorumlake.llm.queries import TOXIC, toxicity_model
from quorumlake.llm.shared import clear, cut, cut_at, hold_batches, made, ship


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    hold_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC."""
    _prepare(spark)
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), score_col="__ql_toxicity")
    return scored.where(F.col("__ql_toxicity") < TOXIC).drop("__ql_toxicity")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three consecutive lines."""
    return _sized(line_dedup.dedup_lines(docs)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id.

    Of rows that share this id the least row stays. Rows with a null id are linked with nothing and stay.
    """
    _prepare(spark)
    found = cut(setsketch.near_duplicates(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("__ql_id")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")), "found")
    here = F.col("doc_id") == F.col("__ql_id")
    # those that go are fewer than those that stay; stored, so that Spark knows by their size how to join them
    gone = cut(found.where("not kept").select("__ql_id"), "gone")
    own = docs.join(gone, here, "left_anti")
    several = cut(found.where("kept and rows > 1").select("__ql_id"), "several")
    if several.isEmpty():
        return own
    least = own.join(several, here, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("__ql_row")).select("__ql_row.*")
    return own.join(several, here, "left_anti").unionByName(least)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    _prepare(spark)
    found = pii.annotate(docs, spans_col="__ql_spans", clean_col="__ql_clean")
    return _sized(found.withColumn("text", F.col("__ql_clean"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in sequences of 4096."""
    _prepare(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near dedup", drop_near_duplicates), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's table is deleted, with all that the stage wrote on its way, once the next one stands."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        before = set(made())
        docs, path = cut_at(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        clear(spark, last + [p for p in made() if p not in before and p != path])
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the classifier nor the hash-based stages can be put in SQL.
ORACLE_SQL = None
