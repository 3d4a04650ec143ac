import base64
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import media, reports, scores, text
from quorumlake.operators import writes
from quorumlake.streaming import sse


def one(spark, column, **values):
    return spark.range(1).select(*[(v if hasattr(v, "_jc") else F.lit(v)).alias(k) for k, v in values.items()]).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


def test_scores(spark):
    assert one(spark, scores.round2(F.lit(7.8149999999999995))) == 7.82
    assert [one(spark, scores.clamp(F.lit(x).cast("double"), 0.0, 10.0)) for x in (None, float("nan"), float("inf"), float("-inf"), -1.0, 5.0, 11.0)] == [0, 0, 0, 0, 0, 5, 10]
    assert one(spark, scores.stage(F.lit(8.5), F.lit(9.0), F.lit(5), F.lit(0), F.lit(2))) == "published"
    assert one(spark, scores.stage(F.lit(8.5), F.lit(9.0), F.lit(5), F.lit(0), F.lit(3))) == "promoted"
    assert one(spark, scores.stage(F.lit(0.0), F.lit(None).cast("double"), F.lit(0), F.lit(0), F.lit(0))) == "draft"


def test_text(spark):
    for slug, name in {"meta-science": "Meta Science", "foo_BAR": "Foo BAR", "a  b": "A B"}.items():
        assert one(spark, text.slug_name(F.lit(slug))) == name
    for m, hit in {"HTTP 429": True, "RATELIMIT_EXCEEDED": True, "ratelimit_exceeded": False, "Quota hit": True, "Rate Limit": True, "timeout": False}.items():
        assert one(spark, text.is_rate_limit(F.lit(m))) == hit
    assert one(spark, text.clean_tags(F.array(*map(F.lit, (" A", "a", "", "B "))))) == ["a", "b"]
    assert one(spark, text.contains_any_case(F.lit("aQb"), "a\\q")) and not one(spark, text.contains_any_case(F.lit("ab"), "\\%"))
    assert one(spark, text.media_type(F.lit("Application/JSON; x"))) == "application/json"
    assert [one(spark, text.response_kind(F.lit(x))) for x in ("text/html", "image/svg+xml", "a/b+json", "image/png")] == ["text", "text", "json", "blob"]
    assert one(spark, F.length(text.truncated(F.lit("x" * 400)))) == 300
    assert one(spark, text.first_host(F.lit(" a.b , c"), F.lit("z"))) == "a.b"
    assert one(spark, text.data_url_payload(F.lit("data:x,YQ=="))) == "YQ==" and one(spark, text.data_url_payload(F.lit("none"))) is None
    assert [one(spark, text.to_number(F.lit(x))) for x in ("12", "", "z")] == [12.0, 0.0, None]
    name = text.display_name(F.lit(None).cast("string"), F.lit(" "), F.lit(""), F.lit("me@x.y"), F.lit("user_000001"))
    assert one(spark, name) == "me"
    assert one(spark, text.stage_label(F.lit("under_review"))) == "under review"


def test_reports(spark):
    r = one(spark, reports.rigor_report(F.lit('```json\n{"logicScore": 12, "methodologyScore": "9", "strengths": ["a","b","c","d","e","f","g"]}\n```')))
    assert (r["logicScore"], r["methodologyScore"], r["overallScore"], len(r["strengths"]), r["critique"]) == (10, 0, 2, 6, "")
    for t in ("not json", '[{"logicScore": 5}]'):
        assert one(spark, reports.rigor_report(F.lit(t)))["overallScore"] == 0
    assert one(spark, reports.rigor_report(F.lit("null"))) is None
    passes = F.array(*[reports.survey_pass(F.lit(t), F.lit("p")) for t in ('{"verdict": "endorse", "confidence": 1}', '{"verdict": "what", "confidence": 1}', '{"verdict": "endorse", "confidence": 0}')])
    s = one(spark, reports.survey(passes))
    assert (s["confidence"], s["endorsing"], s["consensus"]) == (0.75, 2, "endorse")


def test_report_parsed_once(spark):
    """However many parts of a report are used, its text is parsed once for the filter and once for all of them."""
    made = spark.createDataFrame([("{}",)], "raw string").select(reports.rigor_report(F.col("raw")).alias("r")).where("r is not null").select("r.overallScore", "r.logicScore", "r.critique")
    assert 1 <= made._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") <= 2


def test_media(spark):
    for h, kind in {"52494646" + "00" * 8: "wav", "1A45DFA3" + "00" * 8: "webm", "494433" + "00" * 9: "mp3", "FFFB" + "00" * 10: "mp3", "00000000667479700000000000": "mp4", "4F676753" + "00" * 8: "ogg", "00" * 11: "unknown", "00" * 12: "unknown"}.items():
        assert one(spark, media.audio_format(F.unhex(F.lit(h)))) == kind
    b = base64.b64encode(b"\x00\x00\xff\x7f\x00\x80").decode()
    assert spark.createDataFrame([(b,)], "b string").select(media.pcm16(F.col("b"))).first()[0] == pytest.approx([0, 32767 / 32768, -1])


def test_writes(spark):
    t = datetime
    refs = "references array<struct<citation:string,url:string>>"
    papers = spark.createDataFrame([(1, "u", "old", "oa", "b", ["x"], [], 1, t(2024, 1, 1)), (2, "v", "x", "y", "b", ["x"], [], 0, t(2024, 1, 1))], f"id long, author_id string, title string, abstract string, body string, fields array<string>, {refs}, revision_count int, updated_at timestamp")
    edits = [(10, 1, "u", "new", "na", "nb", ["z"], [("c", None)], "why", t(2024, 2, 1)), (11, 1, "u", "newer", "na2", "nb2", [], [], "again", t(2024, 2, 2)), (12, 2, "u", "no", "", "", [], [], "no", t(2024, 2, 1)), (13, 9, "u", "no", "", "", [], [], "no", t(2024, 2, 1))]
    edits = spark.createDataFrame(edits, f"edit_id long, id long, author_id string, title string, abstract string, body string, fields array<string>, {refs}, summary string, at timestamp")
    rows, now, refused = writes.revise(papers, edits)
    assert sorted(tuple(r)[:5] for r in rows.collect()) == [(1, 2, "old", "oa", "why"), (1, 3, "new", "na", "again")]
    assert {r["id"]: (r["title"], r["body"], r["fields"], r["revision_count"], r["updated_at"].day) for r in now.collect()} == {1: ("newer", "nb2", [], 3, 2), 2: ("x", "b", ["x"], 0, 1)}
    assert {r["edit_id"]: r["status"] for r in refused.collect()} == {12: "403", 13: "404"}
    ok, refused = writes.split_valid(spark.createDataFrame([("endorse",), ("x",), (None,)], "s string"), F.col("s").isin("endorse", "challenge", "reject"))
    assert (ok.count(), refused.count()) == (1, 2)
    assert writes.delete_cascade(spark.createDataFrame([(1, 1), (2, 2)], "id long, p long"), spark.createDataFrame([(1,)], "id long"), "p", "id").count() == 1


def test_latest_wins(spark):
    t = datetime
    rows = [(1, 1, 7, "endorse", t(2024, 1, 1)), (1, 1, 8, "reject", t(2024, 1, 1)), (1, 1, 3, "challenge", t(2023, 12, 31)), (2, 1, 9, "other", t(2024, 1, 1))]
    votes = spark.createDataFrame(rows, "paper_id long, user_id long, event_id long, stance string, ts timestamp_ntz")
    got = writes.latest_wins(votes, ["paper_id", "user_id"], "ts", "event_id", "stance", ("endorse", "challenge", "reject"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3, 8, t(2023, 12, 31), t(2024, 1, 1), "reject"), (2, 1, 9, 9, t(2024, 1, 1), t(2024, 1, 1), None)]
    plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


#: (rigor, confidence, stances with the reviewer's number, replies of each comment) and (endorse, challenge, reject, comments, combined, stage).
GOLDEN = [
    ((7.6, 0.72, "e1 e2 e3 c4", (1, 1)), (3, 1, 0, 4, 7.82, "promoted")),
    ((8.4, 0.86, "e1 e2 e3 e4 e1", (1, 0)), (4, 0, 0, 3, 9.01, "promoted")),
    ((7.0, 0.60, "e1 c2 c3", (1,)), (1, 2, 0, 2, 6.4, "under_review")),
    ((8.7, 0.90, "e1 e2 e3 e4 e2", (2,)), (4, 0, 0, 3, 9.23, "promoted")),
    ((8.0, 0.78, "e1 e2 e3 e4 r4", (0, 0)), (4, 0, 0, 2, 8.65, "promoted")),
    ((5.6, 0.45, "e1 c2", (0,)), (1, 1, 0, 1, 5.36, "under_review")),
]


def test_golden_rows(spark):
    """The seed's papers, loaded from nested documents: counts, scores and stages."""
    from quorumlake.sources.domain import scored

    names = {"e": "endorse", "c": "challenge", "r": "reject"}
    docs = [(k + 1, "u0", "t", "a", "b", ["x"], [], (rigor,), (conf,), [(f"u{v[1]}", names[v[0]], "j") for v in votes.split()], [("u1", "c", [("u2", "r")] * n) for n in replies]) for k, ((rigor, conf, votes, replies), _) in enumerate(GOLDEN)]
    schema = "id long, author_id string, title string, abstract string, body string, fields array<string>, references array<struct<citation:string,url:string>>, rigor struct<overallScore:double>, survey struct<confidence:double>, reviews array<struct<author_id:string,stance:string,justification:string>>, comments array<struct<author_id:string,body:string,replies:array<struct<author_id:string,body:string>>>>"
    people = spark.createDataFrame([(f"u{k}", "n") for k in range(5)], "id string, display_name string")
    at = F.lit(datetime(2024, 1, 1))
    frame = spark.createDataFrame(docs, schema)
    tables = writes.reseed({"profiles": people, **writes.load(frame, at)}, frame, people, at)
    assert {n: t.count() for n, t in tables.items()} == {"papers": 6, "profiles": 5, "reviews": 21, "comments": 15, "reports": 6}
    counts = tables["reviews"].groupBy(F.col("paper_id").alias("id")).agg(*[F.count_if(F.col("stance") == s).alias(s) for s in names.values()])
    said = {r[0]: r[1] for r in tables["comments"].groupBy("paper_id").count().collect()}
    got = scored(tables["papers"].withColumnRenamed("stage", "stored").join(counts, "id"), "rigor_score", "ai_confidence").select("*", scores.round2(F.col("combined")).alias("shown")).orderBy("id").collect()
    assert [(r["endorse"], r["challenge"], r["reject"], said[r["id"]], r["shown"], r["stage"]) for r in got] == [g for _, g in GOLDEN]
    assert [r["stored"] for r in got] == [r["stage"] for r in got]
    assert tables["comments"].where("parent_id is not null").join(tables["comments"].select(F.col("id").alias("parent_id"), F.col("paper_id").alias("p")), "parent_id").where("p = paper_id").count() == 6


def test_sse(spark):
    chunks = spark.createDataFrame([(1, 0, "data: a\nda"), (1, 1, "ta:b\n\nx: y\r\n\r\ndata:c\r\rda"), (1, 2, "ta: tail")], "stream_id long, chunk_no long, chunk string")
    got = sse.split_frames(chunks).select("frame_no", sse.data_of(F.col("frame")).alias("d")).orderBy("frame_no").collect()
    assert [r["d"] for r in got] == ["a\nb", None, "c", "tail"]
    pending: dict = {}
    assert sse.in_sequence(pending, 0, [2, 0, 1, 4, 4, 0], list("caberx")) == ([(0, "a"), (1, "b"), (2, "c")], 3) and pending == {4: "er"}


def test_resequence_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (1, 4, "e"), (2, 0, "z")], "stream_id long, seq long, data string").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("stream_id long, seq long, data string").parquet(f"{tmp_path}/in")
    q = sse.resequence(rows).writeStream.format("memory").queryName("resequenced").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("resequenced").collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z")]


def test_frames_stream(spark, tmp_path):
    """Chunks of one stream that come in the wrong order, over two batches."""
    schema = "stream_id long, chunk_no long, chunk string"
    for n, rows in enumerate(([(1, 1, "b\n\nda"), (2, 1, "later")], [(1, 0, "data: a"), (1, 2, "ta: c\n"), (1, 3, "\nrest")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"in{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
        q = sse.stream_frames(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, "data: ab"), (1, "data: c")]


def test_quiet_streams_end(spark, tmp_path):
    """What waits behind a gap, and a rest without an end, come once a stream has been silent."""
    import time

    spark.createDataFrame([(1, 0, "data: a\n\nda"), (1, 2, "ta: c")], "stream_id long, chunk_no long, chunk string").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("stream_id long, chunk_no long, chunk string").parquet(f"{tmp_path}/in")
    q = sse.stream_frames(rows, quiet=500).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(60):
            if spark.table("quiet").count() == 2:
                break
            time.sleep(0.5)
        assert sorted(r["frame"] for r in spark.table("quiet").collect()) == ["data: a", "data: c"]
    finally:
        q.stop()


def test_debounce_and_retries(spark):
    base = datetime(2024, 1, 1)
    ev = spark.createDataFrame([(base.replace(microsecond=0), "a"), (base.replace(microsecond=100_000), "b"), (base.replace(second=2), "c")], "ts timestamp, value string")
    assert sorted(r["value"] for r in sse.debounce(ev).collect()) == ["b", "c"]
    tries: dict = {}

    def call(p):
        tries[p] = tries.get(p, 0) + 1
        if p == "bad" or (p == "slow" and tries[p] < 3):
            raise ValueError("429" if p == "slow" else "no")
        return p.upper()

    items = spark.createDataFrame([(0, "ok"), (1, "slow"), (2, "bad")], "index long, payload string").coalesce(1)
    assert sse.rate_limited("Quota hit") and sse.rate_limited("x RATELIMIT_EXCEEDED") and not sse.rate_limited("ratelimit_exceeded")
    got = {r["index"]: (r["result"], r["error"], r["attempts"]) for r in sse.retrying_map(items, call, lambda m: "429" in m, first_wait=0.01).collect()}
    assert got == {0: ("OK", None, 1), 1: ("SLOW", None, 3), 2: (None, "no", 1)}
