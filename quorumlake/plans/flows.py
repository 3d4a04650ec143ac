"""The queries that show flows: frames and events of streams, chunks out of order, retries, jobs side by side."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import reports
from quorumlake.plans import refresh
from quorumlake.plans.registry import query
from quorumlake.sources import files
from quorumlake.sources.domain import Domain
from quorumlake.streaming import events, jobs, sse

#: Characters of a chunk: frames are cut wherever it ends.
CHUNK = 7


def _chunks(d: Domain) -> DataFrame:
    """Streams made from conversations: an event for each turn, then done twice; cut into short chunks. Every third stream has CRLF, each fifth has an error."""
    c = d.table("conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    end = F.when(conv % 3 == 0, "\r\n").otherwise("\n")
    line = F.concat(F.lit('data: {"type": "transcript",'), end, F.lit('data:"data": "t'), turn.cast("string"), F.lit(' "}'), end, end)
    line = F.when((conv % 5 == 0) & (turn == 2), F.concat(F.lit('data: {"type": "error", "error": "stop"}'), end, end)).otherwise(line)
    line = F.concat(F.when(turn == 1, F.concat(F.lit(": a comment"), end, end)).otherwise(""), line)
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "").alias("all"))
    whole = whole.select(F.col("conv_id").alias("stream_id"), F.concat("all", F.lit('data: {"done": true}\n\ndata: {"done": true}')).alias("all"))
    n = F.ceil(F.length("all") / CHUNK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("chunk_no"), F.substr(F.col("all"), i * CHUNK + 1, F.lit(CHUNK)).alias("chunk")))
    return whole.select("stream_id", F.explode(cut).alias("c")).select("stream_id", "c.*")


def _frames(d: Domain) -> DataFrame:
    return sse.split_frames(_chunks(d)).select("stream_id", "frame_no", sse.data_of(F.col("frame")).alias("data"))


_TURNS = "(select conv_id, turn, conv_id % 5 = 0 and turn = 2 bad, count(*) over (partition by conv_id) n, row_number() over (partition by conv_id order by turn) - 1 k from conversations)"
#: Each conversation's frames: its turns, a comment before the second, and two ends.
_FRAMES = f"""(select conv_id stream_id, k + cast(turn >= 1 as int) frame_no, case when bad then '{{"type": "error", "error": "stop"}}' else '{{"type": "transcript",' || chr(10) || '"data": "t' || turn || ' "}}' end as data, turn, bad, k from {_TURNS}
 union all select conv_id, 1, null, null, null, null from conversations where turn = 1
 union all select conv_id, count(*) + max(cast(turn = 1 as int)) + j, '{{"done": true}}', null, null, null from conversations cross join (values (0), (1)) t(j) group by conv_id, j)"""


@query(f"select stream_id, frame_no, data from {_FRAMES}")
def frames_split(d):
    return _frames(d)


_HEARD = """(select conv_id stream_id, k + cast(turn >= 1 as int) frame_no, case when bad then 'error' else 'transcript' end kind, case when not bad then 't' || turn || ' ' end as data, case when bad then 'stop' end error,
  case when not bad then string_agg('t' || turn || ' ', '') over (partition by conv_id order by turn) end as full
 from """ + _TURNS + """ where conv_id % 5 <> 0 or turn <= 2
 union all select conv_id, count(*) + max(cast(turn = 1 as int)), 'done', null, null, string_agg('t' || turn || ' ', '' order by turn) from conversations group by conv_id having conv_id % 5 <> 0 or max(turn) < 2)"""


@query(f"select * from {_HEARD}")
def events_heard(d):
    return events.dispatched(_frames(d))


@query(f"select stream_id, frame_no, kind, data, error, case when kind = 'done' then \"full\" end as full from {_HEARD}")
def events_heard_once(d):
    return events.dispatched(_frames(d), running=False)


RAW = ('{"done": true}', '{"type": "audio", "data": "QQ=="}', '{"type": "audio", "data": 5}', "no json", "null", '{"type": "error", "error": "e"}', '{"type": "user_transcript", "data": "q"}', None)


@query(f"""select event_id id, ['done', 'audio', 'error', 'error', 'error', 'error', 'user_transcript', null][cast(event_id % 8 as int) + 1] kind, [null, 'QQ==', null, null, null, null, 'q', null][cast(event_id % 8 as int) + 1] as data,
 [null, null, '{events.UNEXPECTED}', '{events.MALFORMED}', '{events.UNEXPECTED}', 'e', null, null][cast(event_id % 8 as int) + 1] error from events""")
def events_parsed(d):
    raw = F.get(F.array(*[F.lit(x).cast("string") for x in RAW]), (F.col("event_id") % len(RAW)).cast("int"))
    return d.table("events").select(F.col("event_id").alias("id"), events.event_of(raw).alias("e")).select("id", "e.kind", "e.data", "e.error")


@query("""select conv_id stream_id, turn seq, 't' || turn || case when conv_id % 3 = 0 and turn = 1 then 't1' else '' end as data from conversations where conv_id % 4 <> 0 or turn < 2""")
def chunks_in_sequence(d):
    c = d.table("conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    own = c.where(~((conv % 4 == 0) & (turn == 2))).select(conv.alias("stream_id"), turn.alias("seq"), F.concat(F.lit("t"), turn.cast("string")).alias("data"), (-turn).alias("arrived"))
    again = c.where((conv % 3 == 0) & (turn == 1)).select(conv.alias("stream_id"), turn.alias("seq"), F.lit("t1").alias("data"), F.lit(9).cast("long").alias("arrived"))
    return sse.gap_free(own.unionByName(again), "arrived")


@query("select conv_id stream_id, string_agg(case when turn % 2 = 0 then role || ';' else '' end, '' order by turn) as \"all\" from conversations group by conv_id")
def chunks_collected(d):
    c = d.table("conversations")
    return sse.collected(c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("chunk_no"), F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(";"))).otherwise("").alias("chunk")))


@query("""select conv_id stream_id, turn chunk_no, row_number() over (partition by conv_id, turn order by t) - 1 part, t as type, data from (
 select conv_id, turn, 'transcript' t, role as data, 0 o from conversations where turn % 3 <> 0 union all select conv_id, turn, 'transcript', '', 1 from conversations where 1 = 0)""")
def deltas(d):
    c = d.table("conversations")
    turn = F.col("turn")
    return sse.delta_events(c.select(F.col("conv_id").alias("stream_id"), turn.alias("chunk_no"), F.when(turn % 3 != 0, F.col("role")).alias("transcript"), F.when(turn % 2 == 0, "").alias("audio")))


@query("""select user_id, ts, event_id value from (select *, lead(ts) over (partition by user_id order by ts, event_id) following from events) where following is null or following >= ts + interval 6 hours""")
def searches_debounced(d):
    e = d.table("events").select("user_id", "ts", F.col("event_id").alias("value"))
    return sse.debounce(e, gap="6 hours", keys=["user_id"]).select("user_id", "ts", "value")


@query("select conv_id stream_id, turn // 2 request_no, turn from conversations c where turn // 2 = (select max(turn // 2) from conversations x where x.conv_id = c.conv_id)")
def newest_requests(d):
    rows = d.table("conversations").select(F.col("conv_id").alias("stream_id"), F.floor(F.col("turn") / 2).alias("request_no"), "turn")
    return sse.newest_request(rows, rows.select("stream_id", "request_no")).select("stream_id", "request_no", "turn")


def _answer(payload: str) -> str:
    k = int(payload)
    if k % 10 == 3:
        raise ValueError("no answer")
    if k % 10 == 7:
        raise ValueError("HTTP 429")
    return f"answer {k}"


def _answers(d: Domain) -> DataFrame:
    k = F.col("event_id")
    return sse.retrying_map(d.table("events").where("event_type = 'click'").select(k.alias("index"), k.cast("string").alias("payload")), _answer, retries=2, first_wait=0.0, most_wait=0.0)


@query("select event_id as \"index\", case when event_id % 10 not in (3, 7) then 'answer ' || event_id end result, case event_id % 10 when 3 then 'no answer' when 7 then 'HTTP 429' end error, case when event_id % 10 = 7 then 3 else 1 end attempts from events where event_type = 'click'")
def calls_retried(d):
    return _answers(d)


@query("select count(*) processed, count(*) filter (event_id % 10 in (3, 7)) errors from events where event_type = 'click'")
def calls_counted(d):
    return sse.totals(_answers(d))


@query("""with c as (select * from events where event_type = 'click')
 select 'started' as type, cast(null as bigint) as "index", cast(null as varchar) result, count(*) total, null processed, null errors from c union all select 'complete', null, null, null, count(*), count(*) filter (event_id % 10 in (3, 7)) from c
 union all select 'processing', event_id, null, null, null, null from c union all select 'progress', event_id, case when event_id % 10 not in (3, 7) then 'answer ' || event_id end, null, null, null from c""".replace("with c as", ", c as", 1))
def progress_told(d):
    return sse.progress_events(_answers(d)).select("type", "index", "result", "total", "processed", "errors")


@query("""select conv_id stream_id, b block_no, least(n, (b + 1) * 3) - least(n, b * 3) + 0e0 total, (b + 1) * 3 >= n ended from (
 select conv_id, n, unnest(range(0, greatest(cast(ceil(n / 3e0) as int), 1))) b from (select conv_id, count(*) n from conversations group by conv_id))""")
def blocks_played(d):
    s = d.table("conversations").groupBy(F.col("conv_id").alias("stream_id")).agg(F.array_repeat(F.lit(1.0).cast("float"), F.count("*").cast("int")).alias("samples"))
    total: Column = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return events.playout(s, 3).select("stream_id", "block_no", total.alias("total"), "ended")


@query("select (select count(*) from papers) papers, (select count(*) from reviews) reviews, (select count(*) from comments) comments")
def counted_together(d):
    found = jobs.together({"papers": d.papers().count, "reviews": d.reviews().count, "comments": d.comments().count})
    return d.spark.createDataFrame([tuple(found.values())], "papers long, reviews long, comments long")


@query("select count(*) n, 'summaries,papers' forgotten from papers")
def tables_held(d):
    held = jobs.Held()
    held.define("papers", lambda: d.papers().select("id"))
    held.define("summaries", lambda: held.get("papers").agg(F.count("*").alias("n")), "papers")
    n = held.get("summaries").first()["n"]
    gone = ",".join(sorted(held.changed("papers"), reverse=True))
    return d.spark.createDataFrame([(n, gone)], "n long, forgotten string")


def _send(method: str, url: str, body: str | None) -> tuple[int, str | None, bytes]:
    """An answer without a network: JSON, text, bytes, or an error, by the number in the URL."""
    k = int(url.rsplit("/", 1)[1])
    kind = ("application/json", "text/html", "image/png")[k % 3]
    return (404 if k % 5 == 4 else 200), kind, f'{{"n": {k}}}'.encode()


@query("""select event_id id, case when event_id % 7 <> 0 then case when event_id % 5 = 4 then 404 else 200 end end status, case when event_id % 7 <> 0 then ['json', 'text', 'blob'][cast(event_id % 3 as int) + 1] end kind,
 case when event_id % 7 <> 0 and event_id % 3 <> 2 then '{"n": ' || event_id || '}' end as text, case when event_id % 7 = 0 then 'GET requests cannot have a body' when event_id % 5 = 4 then 'HTTP 404' end error from events""")
def answers_fetched(d):
    k = F.col("event_id")
    return files.fetched(d.table("events").select(k.alias("id"), F.lit("get").alias("method"), F.concat(F.lit("https://api.example/"), k.cast("string")).alias("url"), F.when(k % 7 == 0, "x").alias("body")), _send)


def _model(question: str) -> str:
    """Answers without a network; papers whose title begins with E get none."""
    if "Title: E" in question:
        raise ValueError("no service")
    if "rigor of this" in question:
        return "```json\n" + json.dumps(dict.fromkeys(reports.AXES, 9.0)) + "\n```"
    return '{"verdict": "endorse", "confidence": 0.8}'


@query(f"""select id paper_id, revision_count revision_number, case when bad then floor(greatest(1e0, least(9e0, 4e0 + log10(greatest(length(body) + length(abstract), 1)) + least(len(refs), 6) * 0.3e0)) * 100 + 0.5) / 100e0 else 9e0 end rigor_score,
 case when bad then 0.5e0 else 1e0 end survey_confidence, 5 passes, case when bad then '{reports.CONSENSUS["waiting"]}' else '{reports.CONSENSUS["endorse"]}' end consensus from (select *, title like 'E%' bad from papers)""")
def reports_made(d):
    made = refresh.make_reports(d.papers(), _model, F.lit(0), retries=0)
    return made.select("paper_id", "revision_number", "rigor_score", "survey_confidence", F.size("survey.passes").alias("passes"), F.col("survey.consensus").alias("consensus"))


TABLES = ("customer", "documents", "events", "lineitem", "orders")


@query("select unnest(['customer', 'documents', 'events', 'lineitem', 'orders']) as name")
def files_discovered(d):
    """The tables that files were found of; a table is a file, or a folder of files of any name and depth."""
    place = files.below(F.col("path"), d.dir)
    found = files.discover(d.spark, d.dir).select(F.regexp_extract(place, r"^/([^/]+)\.parquet(/|$)", 1).alias("name"))
    return found.where(F.col("name").isin(*TABLES)).distinct()
