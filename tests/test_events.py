"""Voice events, playout, conversion of clips, requests, and what else is said in columns."""

import json
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from quorumlake.functions import media, requests, text
from quorumlake.sources import files
from quorumlake.streaming import events


def test_dispatched(spark):
    t = [json.dumps(x) for x in ({"type": "user_transcript", "data": "q"}, {"type": "transcript", "data": "a"}, {"type": "transcript", "data": "b"}, {"done": True}, {"done": True}, {"type": "error", "error": "stop"}, {"type": "audio", "data": "late"})]
    rows = [(1, i, x) for i, x in enumerate(t)] + [(2, 0, "not json"), (2, 1, t[1]), (3, 0, '{"type": "audio", "data": 5}'), (4, 0, None), (4, 1, '{"done": "true"}'), (5, 0, "null")]
    got = [tuple(r) for r in events.dispatched(spark.createDataFrame(rows, "stream_id long, frame_no long, data string")).orderBy("stream_id", "frame_no").collect()]
    assert got == [
        (1, 0, "user_transcript", "q", None, None),
        (1, 1, "transcript", "a", None, "a"),
        (1, 2, "transcript", "b", None, "ab"),
        (1, 3, "done", None, None, "ab"),
        (1, 5, "error", None, "stop", None),
        (2, 0, "error", None, events.MALFORMED, None),
        *((k, n, "error", None, events.UNEXPECTED, None) for k, n in ((3, 0), (4, 1), (5, 0))),
    ]


def test_playout(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, []), (3, None), (4, [1.0, 2.0])], "stream_id long, samples array<float>")
    got = [tuple(r) for r in events.playout(rows, 2).orderBy("stream_id", "block_no").collect()]
    assert got == [(1, 0, [1, 2], False), (1, 1, [3, 0], True), (2, 0, [0, 0], True), (3, 0, [0, 0], True), (4, 0, [1, 2], True)]


def test_converted(spark):
    wav = b"RIFF" + bytes(12)
    rows = spark.createDataFrame([(1, wav), (2, b"OggS" + bytes(12)), (3, None)], "id long, content binary")
    got = {r["id"]: (r["content"], r["error"]) for r in media.converted(rows, ("cp", "{in}", "{out}")).collect()}
    assert got == {1: (wav, None), 2: (b"OggS" + bytes(12), None), 3: (None, None)}
    got = {r["id"]: (r["content"], r["error"]) for r in media.converted(rows, ("false",)).collect()}
    assert got[1] == (wav, None) and got[2] == (None, "false exited with code 1")
    got = {r["id"]: r["error"] for r in media.converted(rows, ("sleep", "60"), seconds=0.2).collect()}
    assert got[1] is None and "timed out" in got[2]
    kinds = [F.array(*map(F.lit, x)) for x in (("audio/mp4", "audio/webm"), ("other",))]
    assert list(spark.range(1).select(*map(media.first_supported, kinds)).first()) == ["audio/webm", None]


def test_requests(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": null}'), (2, "[1]"), (3, "{"), (4, None), (5, '{"a": "' + "x" * 50 + '"}')], "id long, body string")
    good, bad = files.requests(rows, "a long, b string", most_bytes=40)
    assert [(r["id"], r["request"]["a"]) for r in good.collect()] == [(1, 1)]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "no JSON object", 3: "no JSON object", 4: "no JSON object", 5: "too large"}
    shape = {"a": "number?", "b": ("x", "y"), "c": "strings", "d": "references"}
    bodies = ['{"a": null, "b": "x", "c": ["t"], "d": [{"citation": "q", "url": null}]}', '{"a": 1.5, "b": "y", "c": [], "d": []}', '{"a": "1", "b": "z", "c": [1], "d": [{"citation": 5, "url": null}]}', '{"b": "x", "c": "t", "d": [{"url": "u"}]}', "[]", None, '{"a": 1, "b": 2, "c": [null], "d": {}}']
    got = requests.checked(spark.createDataFrame(list(enumerate(bodies)), "id long, body string"), shape).orderBy("id").collect()
    assert [r["errors"] for r in got] == [
        [], [], ["a: not a number", "b: none of x, y", "c: not a list of strings", "d: not a list of references"], ["a: missing", "c: not a list of strings", "d: not a list of references"], ["body: no JSON object"], ["body: no JSON object"],
        ["b: not a string", "c: not a list of strings", "d: not a list of references"],
    ]
    assert got[0]["request"]["d"][0]["citation"] == "q" and requests.REVISION["revisionSummary"] == "string"
    assert files.as_json(good.select("request.*")).first()[0] == '{"a":1,"b":null}'


def test_more_text(spark):
    numbers = [i / 100 for i in range(1001)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select(text.one_decimal(F.col("x")), "i").orderBy("i").collect()]
    assert got == [str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP)) for x in numbers]
    null = F.lit(None).cast("string")
    lit = F.lit
    cells = {
        "url": text.url_with_query(lit("/p"), {"q": lit("a b&c"), "stage": null, "limit": lit(5)}),
        "bare": text.url_with_query(lit("/p"), {"q": null}),
        "full": text.submission_complete(lit("t"), lit("a"), lit("b"), F.array(lit("x"))),
        "blank": text.submission_complete(lit("t"), lit("a"), lit("b"), F.array(lit("x")), lit(" ")),
        "missing": text.submission_complete(null, lit("a"), lit("b"), F.array(lit("x"))),
        "label": text.labelled(lit("a"), {"a": "A"}),
        "key": text.labelled(lit("z"), {"a": "A"}),
        "own": text.is_author(lit("u"), null),
        "errors": text.error_lines(F.array(lit(""), null, lit("bad"))),
    }
    got = spark.range(1).select(*[c.alias(k) for k, c in cells.items()]).first().asDict()
    assert got == {"url": "/p?q=a+b%26c&limit=5", "bare": "/p", "full": True, "blank": False, "missing": False, "label": "A", "key": "z", "own": False, "errors": ["bad"]}


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.bin", b"one"), ("b.bin", b"2"), ("c.bin", None)], "name string, content binary")
    for _ in range(2):
        assert files.write_files(rows, f"file://{tmp_path}/w") == 2
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in files.read_files(spark, f"{tmp_path}/w", "*.bin").collect()}
    assert got == {"a.bin": b"one", "b.bin": b"2"}


def test_held_and_together():
    from quorumlake.streaming import jobs

    assert jobs.together({"a": lambda: 1, "b": lambda: 2}) == {"a": 1, "b": 2} and jobs.together({}) == {}
    made = []

    class Table:
        def __init__(self, name):
            made.append(name)

        def persist(self):
            return self

        def unpersist(self):
            made.append("gone")

    held = jobs.Held()
    held.define("a", lambda: Table("a"))
    held.define("b", lambda: Table("b") if held.get("a") else None, "a")
    held.get("b"), held.get("b")
    assert held.changed("b") == ["b"] and held.changed("a") == ["a"] and made.count("b") == 1


def test_database_table(spark, tmp_path):
    """A table of the database that comes with Spark, whole and in partitions."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("cast(id as int) id", "cast(id % 7 as int) n").write.format("jdbc").options(url=url, dbtable="t", driver=driver).save()
    whole = files.jdbc_table(spark, url, "t", driver=driver)
    parts = files.jdbc_table(spark, url, "t", "id", (0, 50), 4, driver=driver)
    assert whole.count() == 100 and parts.rdd.getNumPartitions() == 4 and sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
