"""The pipeline's stages against what each must do to its own input."""

import re
from itertools import combinations

import duckdb
import pytest

import corpus_pipeline
from quorumlake.llm import packing, pii, queries, shared


def survivors(texts, size=5):
    """The smallest id of each group of near copies, by brute force."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(i for i in sets if sets[i]), 2):
        if min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted(i for i in sets if find(i) == i)


ODD = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "one two three four five six", None), (5, "ONE two three four five six", "en"), (4, "one two three four five six", None), (None, "one two three four five six", "en"), (None, None, None), (7, "word " * 30_000, "en"), (8, "a\nb\nc\nd", "en"), (9, "z\na\nb\nc\nd", "en"), (10, "mail me@x.yy now", "en")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    """Nulls in any column, empty and blank texts, repeated rows and ids, a long text, no rows and no labels, columns that clash."""
    shared.ship(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 key", "'x' row", "lang id", "2 pii_spans")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {"toxicity": len(rows) * 0, "line dedup": len(rows), "near dedup": 10, "pii": len(rows)}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert got.where("start = 0").count() == len(rows) and got.agg({"doc_tokens": "max"}).first()[0] == (max(30_001, 0) if rows else None)
            continue
        assert got.columns == docs.columns
        if rows:
            ids = sorted(str(r["doc_id"]) for r in got.collect())
            if name == "near dedup":
                assert ids == sorted(map(str, [1, 2, 3, 4, 7, 8, 9, 10, None, None]))
            elif name != "toxicity":  # without labels there is no model
                assert len(ids) == left[name]
        else:
            assert got.count() == 0


def test_stage_tables_go(spark, sf):
    before = set(shared.made())
    corpus_pipeline.run(spark, sf).count()
    own = [p for p in shared.made() if p not in before]
    assert sum("stage-" in p for p in own) == 1 and not any("sketches" in p for p in own)


def test_pipeline(spark, sf):
    shared.ship(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert 4 <= len(steps) <= 5

    kept = shared.cut(steps["toxicity"](spark, docs, sf), "test")
    scores = {r["doc_id"]: r["predicted"] for r in queries.op1_toxicity(spark, sf).collect()}
    assert kept.columns == columns and {r[0] for r in kept.select("doc_id").collect()} == {i for i, p in scores.items() if not p}

    lines = shared.cut(steps["line dedup"](spark, kept, sf), "test")
    assert lines.columns == columns and lines.count() == kept.count()
    con = duckdb.connect()
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    after = {r["doc_id"]: r["text"] for r in lines.collect()}
    seen = set()
    for i in sorted(before):
        rows = before[i].split("\n")
        gone = set()
        first = {}
        for p in range(len(rows) - 2):
            w = tuple(rows[p : p + 3])
            if w in seen:
                gone |= set(range(max(p, first.get(w, -9) + 3), p + 3))
            else:
                seen.add(w)
                first[w] = p
        assert after[i] == "\n".join(x for k, x in enumerate(rows) if k not in gone)
    con.close()

    single = shared.cut(steps["near dedup"](spark, lines, sf), "test")
    assert single.columns == columns and sorted(r[0] for r in single.select("doc_id").collect()) == survivors(after)

    clean = shared.cut(steps["pii"](spark, single, sf), "test")
    assert clean.columns == columns and clean.count() == single.count()
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert r["text"] == pii.redact(texts[r["doc_id"]], pii.find_spans(texts[r["doc_id"]]))
        assert not any(s[0] in ("email", "card") for s in pii.find_spans(r["text"]))

    packed = steps["packing"](spark, clean, sf)
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed.select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= packing.CAPACITY
