"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embed_dedup, kneser_ney, line_dedup, packing, pii, setsketch, toxicity, warc
from .shared import hold_batches, new_folder, ship

#: Words in an n-gram of op4's model.
ORDER = 2
#: Score from which a text counts as toxic.
TOXIC = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    hold_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    """Whether a row is held out; one with a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == 2, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learnt from the labelled documents that are not held out, at most toxicity.SAMPLE_ROWS labels: so few rows may be broadcast."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    own = labels.where(~_fold(4) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxicity.SAMPLE_ROWS)
    return toxicity.fit(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir), score_col="score")
    return scored.select("doc_id", _fold(4).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(_table(spark, sf_dir, "documents").select("doc_id", "text"), clean_col=None)
    counts = [F.expr(f"cast(size(filter(pii_spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_list("pii_spans", pii.BASE_KINDS), 256).alias("base_sha256"), pii.span_list("pii_spans").alias("spans"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.fit(documents.where(~_fold(7)), order=ORDER)
    scored = kneser_ney.score(documents, model)
    return scored.select("doc_id", _fold(7).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup.dedup_lines(documents, removed_col="lines_removed")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    number = r"<urn:page:(-?\d+)>"
    # each record as it stands in a WARC file, taken apart again; a revisit's payload is the one that it stands for
    rebuilt = warc.read_archive(spark, path).select("payload", "verified", warc.record_bytes().alias("record"))
    parts = rebuilt.withColumn("header", warc.header_of(F.col("record")))
    kind = warc.field("WARC-Type")
    block = warc.block_of(F.col("record"), F.col("header"), warc.field("Content-Length"))
    records = parts.select("header", kind.alias("record_type"), "verified", F.when(kind == "response", block).otherwise(F.col("payload")).alias("payload"))
    return records.select(
        F.regexp_extract(warc.field("WARC-Record-ID"), number, 1).try_cast("long").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        warc.sha1_base32(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.regexp_extract(warc.field("WARC-Refers-To"), number, 1).try_cast("long").alias("refers_to"),
        "verified",
        (warc.field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), warc.sha1_base32(F.col("payload")))).alias("digest_matches"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"))
    told = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids")
    return bpe.decode(told).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build_index(_table(spark, sf_dir, "embeddings"))
    asked = index.rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query"), F.col("row").alias("own"))
    return ann.search(index, asked)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_pii, op3_near_duplicates, op4_language_model, op5_line_dedup, op6_warc, op7_bpe, op8_packing, op9_near_vectors, op10_nearest)
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": setsketch.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op9_near_vectors": embed_dedup.ORACLE,
}
