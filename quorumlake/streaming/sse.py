"""Server-sent events, chunks out of order, and quiet gaps, in batch and as stateful streams."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_BREAK = re.compile(r"\r\n\r\n|\n\n|\r\r")


def frames(buffer: str) -> tuple[list[str], str]:
    """(whole frames, the unterminated rest)."""
    parts = _BREAK.split(buffer)
    return parts[:-1], parts[-1]


def data_of(frame: Column) -> Column:
    """The data lines of a frame joined by newlines, one leading blank of each stripped; null without any."""
    lines = F.filter(F.split(frame, r"\r\n|\n|\r"), lambda x: x.startswith("data:"))
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))


def collected(chunks: DataFrame) -> DataFrame:
    """(stream_id, chunk_no, chunk) to (stream_id, all): the chunks that aren't empty joined in their order; a stream of empty ones gives an empty text."""
    some = F.filter(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: F.length(c["chunk"]) > 0)
    return chunks.groupBy("stream_id").agg(F.array_join(F.transform(some, lambda c: c["chunk"]), "").alias("all"))


def split_frames(chunks: DataFrame) -> DataFrame:
    """Batch: (stream_id, chunk_no, chunk) to (stream_id, frame_no, frame); the last frame may be unterminated."""
    return collected(chunks).select("stream_id", F.posexplode(F.split("all", _BREAK.pattern)).alias("frame_no", "frame")).where("frame <> ''")


def _rows_of(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts) if parts else pd.DataFrame(columns=columns)


def _timeout(quiet: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout


def stream_frames(chunks: DataFrame, quiet: int | None = None) -> DataFrame:
    """Streaming: (stream_id long, chunk_no long, chunk string), chunks from 0 in any order, to (stream_id, frame).

    State is the next chunk's number, chunks that came too early, and the unterminated rest. With
    quiet, a stream that is silent for so many milliseconds ends: early chunks are taken in their order, the
    rest is a frame, and its state goes. (A query that is to end with the input it finds can't wait so.)
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, seqs, data, rest = state.get if state.exists else (0, [], [], "")
        pending = dict(zip(seqs, data, strict=True))
        if state.hasTimedOut:
            out, rest = frames(rest + "".join(pending[k] for k in sorted(pending)))
            out += [rest] * bool(rest)
            state.remove()
        else:
            rows = _rows_of(batches, ["chunk_no", "chunk"])
            come, following = in_sequence(pending, following, rows["chunk_no"].tolist(), rows["chunk"].tolist())
            out, rest = frames(rest + "".join(x for _, x in come))
            state.update((following, list(pending), list(pending.values()), rest))
            if quiet:
                state.setTimeoutDuration(quiet)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "frame": out})

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, frame string", "following long, seqs array<long>, data array<string>, rest string", "append", _timeout(quiet))


def in_sequence(pending: dict[int, str], following: int, seqs: list[int], data: list[str]) -> tuple[list[tuple[int, str]], int]:
    """Takes chunks in; returns what has become gap-free and the next number. A repeated pending number is appended to, one that has passed is dropped."""
    out = []
    for s, x in zip(seqs, data, strict=True):
        if s >= following:
            pending[s] = pending.get(s, "") + x
        while following in pending:
            out.append((following, pending.pop(following)))
            following += 1
    return out, following


def resequence(chunks: DataFrame, quiet: int | None = None) -> DataFrame:
    """Streaming: (stream_id long, seq long, data string) in any order to the same, gap-free from 0.

    With quiet, a stream that is silent for so many milliseconds ends: what waits behind a gap comes in its order, and its
    state goes. (A query that is to end with the input it finds can't wait so.)
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, seqs, data = state.get if state.exists else (0, [], [])
        pending = dict(zip(seqs, data, strict=True))
        if state.hasTimedOut:
            out = sorted(pending.items())
            state.remove()
        else:
            rows = _rows_of(batches, ["seq", "data"])
            out, following = in_sequence(pending, following, rows["seq"].tolist(), rows["data"].tolist())
            state.update((following, list(pending), list(pending.values())))
            if quiet:
                state.setTimeoutDuration(quiet)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "seq": [s for s, _ in out], "data": [x for _, x in out]})

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, seq long, data string", "following long, seqs array<long>, data array<string>", "append", _timeout(quiet))


def gap_free(chunks: DataFrame, arrived: str) -> DataFrame:
    """Batch: (stream_id, seq, data) and the order of arrival to (stream_id, seq, data): the numbers from 0 up to the first gap; what came twice is joined."""
    each = chunks.where("seq >= 0").groupBy("stream_id", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(arrived).alias("a"), "data"))), lambda x: x["data"]), "").alias("data"))
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) - 1
    return each.withColumn("__place", place).where("__place = seq").drop("__place")


def debounce(events: DataFrame, gap: str = "300 milliseconds", at: str = "ts", value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """The last value before each quiet gap."""
    return events.groupBy(*(keys or []), F.session_window(at, gap)).agg(F.max_by(value, at).alias(value), F.max(at).alias(at)).drop("session_window")


def rate_limited(message: str) -> bool:
    """Whether an error says that the caller was too fast; the same test as functions.text.is_rate_limit, for a worker."""
    low = message.lower()
    return "429" in message or "RATELIMIT_EXCEEDED" in message or "quota" in low or "rate limit" in low


def retrying_map(items: DataFrame, call: Callable[[str], str], retryable: Callable[[str], bool] = rate_limited, retries: int = 7, first_wait: float = 2.0, most_wait: float = 128.0, at_once: int = 2) -> DataFrame:
    """items: (index of any type, payload string) to (index, result, error, attempts), in the order of items.

    A task has at_once calls under way. Only errors that retryable accepts are tried again, with doubled waits; a
    failure is a row, not an abort.
    """

    def one(payload: str) -> tuple[str | None, str | None, int]:
        wait = first_wait
        for attempt in range(1, retries + 2):
            try:
                return call(payload), None, attempt
            except Exception as e:
                if attempt > retries or not retryable(str(e)):
                    return None, str(e), attempt
                time.sleep(wait)
                wait = min(wait * 2, most_wait)
        raise AssertionError

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for rows in batches:
                done = list(pool.map(one, rows["payload"]))
                yield pd.DataFrame([(i, *d) for i, d in zip(rows["index"], done, strict=True)], columns=["index", "result", "error", "attempts"])

    return items.mapInPandas(run, f"index {items.schema['index'].dataType.simpleString()}, result string, error string, attempts long")


def totals(results: DataFrame) -> DataFrame:
    """(processed, errors) of retrying_map's results."""
    return results.agg(F.count("*").alias("processed"), F.count("error").alias("errors"))


def progress_events(results: DataFrame) -> DataFrame:
    """results of retrying_map, stored (they are read twice), to the events that tell of them: (type, index, result, error, total, processed, errors).

    In the order of `at`, two events an item: processing, then progress with its result or error;
    before all started with the total, behind all complete with counts. Failed items count as processed.
    """
    none = {"index": results.schema["index"].dataType, "result": "string", "error": "string"}
    counts = {c: F.lit(None).cast("long").alias(c) for c in ("total", "processed", "errors")}
    own = results.select(F.explode(F.array(F.struct(F.lit(1).alias("step"), F.lit("processing").alias("type")), F.struct(F.lit(2).alias("step"), F.lit("progress").alias("type")))).alias("e"), "index", "result", "error")
    items = own.select(F.struct(F.lit(1).alias("part"), "index", "e.step").alias("at"), "e.type", "index", *[F.when(F.col("e.step") == 2, F.col(c)).alias(c) for c in ("result", "error")], *counts.values())
    totals = results.agg(F.count("*").alias("n"), F.count("error").alias("bad"))
    ends = totals.select(F.explode(F.array(F.lit(0), F.lit(2))).alias("part"), "n", "bad")
    last = F.col("part") == 2
    ends = ends.select(
        F.struct("part", F.lit(None).cast(none["index"]).alias("index"), F.lit(0).alias("step")).alias("at"), F.when(last, "complete").otherwise("started").alias("type"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
        F.when(~last, F.col("n")).alias("total"), F.when(last, F.col("n")).alias("processed"), F.when(last, F.col("bad")).alias("errors"),
    )
    return ends.unionByName(items)


def after_commit(rows: DataFrame, job: Callable[[DataFrame], None], checkpoint: str, once: bool = True):
    """Streaming: starts job for each batch of rows that have been written; its errors are logged and don't stop the stream."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            job(batch)
        except Exception:
            logging.getLogger(__name__).exception("the job after batch %d failed", number)

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def delta_events(chunks: DataFrame) -> DataFrame:
    """(stream_id, chunk_no, transcript, audio) to (stream_id, chunk_no, part, type, data): what a chunk has of either, the transcript first; nulls and empty parts give none."""
    parts = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("data")) for k in ("transcript", "audio")])
    full = F.filter(parts, lambda p: F.length(p["data"]) > 0)
    return chunks.select("stream_id", "chunk_no", F.posexplode(full).alias("part", "p")).select("stream_id", "chunk_no", "part", "p.type", "p.data")


def newest_request(frames_: DataFrame, requests: DataFrame) -> DataFrame:
    """The frames of each stream's newest request; those of requests that a newer one has replaced go. frames_: (stream_id, request_no, ...), requests: (stream_id, request_no)."""
    newest = requests.groupBy("stream_id").agg(F.max("request_no").alias("request_no"))
    return frames_.join(newest, ["stream_id", "request_no"], "left_semi")
