"""Events of a voice response: their kinds, their order, and the transcript that grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events that carry data, and what is said of frames that are no events.
DATA_KINDS = ("user_transcript", "transcript", "audio")
MALFORMED, UNEXPECTED = "Received malformed SSE JSON payload", "Received unexpected SSE event shape"


def event_of(data: Column) -> Column:
    """struct of kind (done, one of DATA_KINDS, error), data and error, from a frame's JSON.

    What is no JSON, and JSON of another shape, is an error that says so. done: true goes before any
    type; only a string is taken as data or error. No text gives null.
    """
    raw = F.try_parse_json(data)

    def typed(name: str, kind: str) -> Column:
        value = F.try_variant_get(raw, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == kind, F.try_variant_get(raw, f"$.{name}", "string"))

    kind, text, error = (typed(n, "STRING") for n in ("type", "data", "error"))
    done = F.coalesce(typed("done", "BOOLEAN") == "true", F.lit(False))
    carries = F.coalesce(kind.isin(*DATA_KINDS) & text.isNotNull(), F.lit(False))
    fails = F.coalesce((kind == "error") & error.isNotNull(), F.lit(False))

    def made(kind_: Column, data_: Column, error_: Column) -> Column:
        return F.struct(kind_.alias("kind"), data_.alias("data"), error_.alias("error"))

    none = F.lit(None).cast("string")
    wrong = F.when(raw.isNull(), MALFORMED).when(fails, error).otherwise(UNEXPECTED)
    return F.when(data.isNotNull(), F.when(done, made(F.lit("done"), none, none)).when(carries, made(kind, text, none)).otherwise(made(F.lit("error"), none, wrong)))


def dispatched(frames: DataFrame, running: bool = True) -> DataFrame:
    """(stream_id, frame_no, data) to what a listener hears: (stream_id, frame_no, kind, data, error, full).

    A stream ends with its first error; only its first done counts. full is the transcript up to here,
    for transcript and done events; running=False gives it for done alone, so that a long stream doesn't
    repeat it with every event. Frames without data are skipped.
    """
    order = Window.partitionBy("stream_id").orderBy("frame_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    events = frames.where("data is not null").select("stream_id", "frame_no", event_of(F.col("data")).alias("e")).select("stream_id", "frame_no", "e.*")
    seen = events.withColumns({f"__{k}": F.coalesce(F.max(F.col("kind") == k).over(before), F.lit(False)) for k in ("error", "done")})
    heard = seen.where(~F.col("__error") & ~(F.col("__done") & (F.col("kind") == "done")))
    said = F.when(F.col("kind") == "transcript", F.col("data"))
    if not running:
        parts = F.array_sort(F.collect_list(F.when(F.col("kind") == "transcript", F.struct("frame_no", "data"))))
        ends = heard.where("kind = 'done'").select("stream_id", F.col("frame_no").alias("__end"))
        whole = heard.join(ends, "stream_id").where("frame_no < __end").groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["data"]), "").alias("__full"))
        own = heard.join(whole, "stream_id", "left")
        return own.select("stream_id", "frame_no", "kind", "data", "error", F.when(F.col("kind") == "done", F.coalesce("__full", F.lit(""))).alias("full"))
    full = F.array_join(F.collect_list(said).over(order), "")
    return heard.withColumn("full", full).select("stream_id", "frame_no", "kind", "data", "error", F.when(F.col("kind").isin("transcript", "done"), F.col("full")).alias("full"))


def playout(streams: DataFrame, block: int) -> DataFrame:
    """(stream_id, samples array<float>) to what a player pulls: (stream_id, block_no, samples, ended), block samples at a time, silence behind the last. An empty stream gives one silent block."""
    n = F.size("samples")
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(n / block).cast("int") - 1, F.lit(0)))
    rows = streams.withColumn("samples", F.coalesce("samples", F.array().cast("array<float>")))
    rows = rows.select("stream_id", "samples", F.explode(numbers).alias("block_no"))
    own = F.slice("samples", F.col("block_no") * block + 1, block)
    silence = F.array_repeat(F.lit(0.0).cast("float"), block - F.size(own))
    return rows.select("stream_id", "block_no", F.concat(own, silence).alias("samples"), ((F.col("block_no") + 1) * block >= n).alias("ended"))
