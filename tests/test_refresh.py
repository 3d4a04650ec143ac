"""New papers, model reports and what they change; files; progress of long jobs."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from quorumlake.functions import reports, text
from quorumlake.operators import writes
from quorumlake.plans import refresh
from quorumlake.plans.catalog import QUERIES
from quorumlake.sources import files
from quorumlake.streaming import sse

DRAFTS = "id long, author_id string, title string, abstract string, body string, fields array<string>, references array<struct<citation:string,url:string>>"


def model():
    rigor = json.dumps(dict.fromkeys(reports.AXES, 9.0))

    def answer(question):
        if "offline" in question:
            raise ValueError("no service")
        return rigor if "rigor of this" in question else '```json\n{"verdict": "endorse", "confidence": 0.8}\n```'

    return answer


def drafts(spark):
    return spark.createDataFrame([(1, "u", " T ", "a", "b", [" X", "x", ""], [("c", " ")]), (2, "u", "T", "offline", "b", ["y"], None), (3, "u", "T", " ", "b", ["y"], []), (4, "u", "T", "a", None, ["y"], []), (5, "u", "T", "a", "b", [], [])], DRAFTS)


def test_create_and_refresh(spark, tmp_path):
    at = F.lit(datetime(2024, 1, 1))
    made, refused = writes.create(drafts(spark), at)
    assert sorted(r["id"] for r in refused.collect()) == [3, 4, 5]
    first = made.where("id = 1").first()
    assert (first["title"], first["fields"], first["stage"], first["rigor_score"], first["references"][0]["url"]) == ("T", ["x"], "draft", None, None)

    refresh.make_reports(made, model(), at).write.parquet(f"{tmp_path}/reports")
    new = spark.read.parquet(f"{tmp_path}/reports")
    told = {r["paper_id"]: r for r in new.collect()}
    assert told[1]["rigor_score"] == 9.0 and told[1]["survey_confidence"] == 1.0 and len(told[1]["survey"]["passes"]) == 5
    assert told[1]["survey"]["consensus"] == reports.CONSENSUS["endorse"]
    # eight characters and no references: 4 + log10(8), citations one less
    assert told[2]["rigor_score"] == 4.9 and told[2]["survey_confidence"] == 0.5 and told[2]["survey"]["consensus"] == reports.CONSENSUS["waiting"]
    assert round(told[2]["rigor"]["logicScore"] - told[2]["rigor"]["citationsScore"], 9) == 1

    votes = spark.createDataFrame([(1, 5, 0, 0)], "paper_id long, endorse long, challenge long, reject long")
    now, changes = refresh.apply_reports(made, new, votes)
    assert {r["id"]: (r["stage"], r["rigor_score"]) for r in now.collect()} == {1: ("published", 9.0), 2: ("draft", 4.9)}
    assert [tuple(r) for r in changes.collect()] == [(1, "draft", "published")]
    assert refresh.make_reports(made.limit(0), model(), at).count() == 0


def test_null_answers(spark):
    made, _ = writes.create(drafts(spark).where("id = 1"), F.lit(datetime(2024, 1, 1)))
    assert refresh.make_reports(made, lambda q: "null", F.lit(1)).first()["survey_confidence"] == 0.5
    assert refresh.make_reports(made, lambda q: "what?", F.lit(1)).first()["rigor_score"] == 0


def test_progress_events(spark):
    results = spark.createDataFrame([(0, "A", None, 1), (1, None, "no", 1)], "index long, result string, error string, attempts long")
    rows = sse.progress_events(results).orderBy("at").drop("at").collect()
    assert [tuple(r) for r in rows] == [
        ("started", None, None, None, 2, None, None),
        ("processing", 0, None, None, None, None, None),
        ("progress", 0, "A", None, None, None, None),
        ("processing", 1, None, None, None, None, None),
        ("progress", 1, None, "no", None, None, None),
        ("complete", None, None, None, None, 2, 1),
    ]
    assert [r["type"] for r in sse.progress_events(results.limit(0)).orderBy("at").collect()] == ["started", "complete"]


def test_files(spark, tmp_path):
    for name in ("a.tsx", "b.txt", "in/c.tsx", "_no.tsx", "_hidden/d.tsx", "in/_e/f.tsx"):
        (tmp_path / "_src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "_src" / name).write_text(name)
    folder = f"{tmp_path}/_src"
    found = files.discover(spark, folder, "*.tsx").collect()
    assert sorted(r["path"].split("_src/")[1] for r in found) == ["a.tsx", "in/c.tsx"]

    seen = []

    def job(batch):
        seen.extend(r["path"] for r in batch.select("path").collect())
        raise ValueError("logged only")

    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.bin").write_bytes(b"1")
    for n in (1, 2):
        q = sse.after_commit(files.watch(spark, f"{tmp_path}/w", "*.bin"), job, f"{tmp_path}/c")
        q.awaitTermination(120)
        assert len(seen) == n and q.exception() is None
        (tmp_path / "w" / f"y{n}.bin").write_bytes(b"22")


def test_tables_of_many_files(spark, tmp_path):
    """A table is found once, be it one file or a folder of files; a folder further down is none."""
    for name in ("orders.parquet", "customer.parquet/part-0.parquet", "customer.parquet/part-1.parquet", "events.parquet/day=1/part-0", "customer.parquet/orders.parquet", "old/lineitem.parquet", "_documents.parquet", "nation.parquet"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    for folder in (f"{tmp_path}/t", f"file://{tmp_path}/t/"):
        assert sorted(r["name"] for r in QUERIES["files_discovered"](spark, folder).collect()) == ["customer", "events", "orders"]


def test_redacted(spark):
    rows = spark.sql("select named_struct('req', named_struct('headers', named_struct('authorization', 's', 'cookie', cast(null as string), 'host', 'h'))) as row")
    r = rows.select(files.redacted(F.col("row"), rows.schema["row"].dataType).alias("row")).first()["row"]["req"]["headers"]
    assert tuple(r) == ("[Redacted]", None, "h")


def test_time_ago(spark):
    now = "2024-06-01 12:00:00"
    cases = {
        "2024-06-01 11:59:50": "less than a minute ago", "2024-06-01 11:59:00": "1 minute ago", "2024-06-01 11:15:31": "44 minutes ago", "2024-06-01 11:00:00": "about 1 hour ago", "2024-06-01 09:00:00": "about 3 hours ago",
        "2024-05-31 06:00:00": "1 day ago", "2024-05-25 12:00:00": "7 days ago", "2024-04-25 12:00:00": "about 1 month ago", "2024-02-01 12:00:00": "4 months ago", "2023-05-01 12:00:00": "about 1 year ago", "2022-11-01 12:00:00": "over 1 year ago",
        "2022-07-01 12:00:00": "almost 2 years ago", "2024-06-01 12:10:00": "in 10 minutes",
    }
    rows = spark.createDataFrame(list(cases), "string").select("value", text.time_ago(F.col("value").cast("timestamp"), F.lit(now).cast("timestamp")).alias("t"))
    assert {r["value"]: r["t"] for r in rows.collect()} == cases
    assert [r[0] for r in spark.createDataFrame([("ada",), ("",), (None,)], "n string").select(text.initial(F.col("n"))).collect()] == ["A", None, None]


def test_deltas_and_newest_request(spark):
    chunks = spark.createDataFrame([(1, 0, "hi", "QQ=="), (1, 1, "", None), (1, 2, None, "QkI=")], "stream_id long, chunk_no long, transcript string, audio string")
    assert [tuple(r) for r in sse.delta_events(chunks).orderBy("chunk_no", "part").collect()] == [(1, 0, 0, "transcript", "hi"), (1, 0, 1, "audio", "QQ=="), (1, 2, 0, "audio", "QkI=")]
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only"), (3, 1, "gone")], "stream_id long, request_no long, frame string")
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)], "stream_id long, request_no long")
    assert sorted(r["frame"] for r in sse.newest_request(rows, asked).collect()) == ["new", "only"]
