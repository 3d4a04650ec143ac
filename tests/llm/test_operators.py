"""Each operator against a brute-force version, a round trip or held-out accuracy, on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quorumlake.llm import ann, bpe, components, embed_dedup, kneser_ney, line_dedup, packing, pii, queries, setsketch, shared, toxicity, warc, words

SEP = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} Über" for i in range(60_000))
#: Nulls, empty and blank texts, repeated rows, a very long text.
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, "One two THREE four five six", "en", None, 9), (5, "one two three four five six", None, "s", 9), (5, "one two three four five six", None, "s", 9), (None, "one two three four five six", "en", "s", 1), (7, LONG, "en", "s", 7), (8, "a\x1cb   c<|endoftext|>d Ǆ é", "en", "s", 1)]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    shared.ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("ids", F.lit("x")).withColumn("key", F.lit(1)).withColumn("score", F.lit("s"))


def texts(sf, more=""):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' {more} order by 1").fetchall()


def tokens(text):
    return SEP.findall((text or "").translate(LOWER))


def shingles(text, size):
    w = tokens(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_words(sf):
    import pyarrow as pa

    rows = [t for _, t in texts(sf)] + [None, "", "  ", LONG, "A a", "é É"]
    h, n = words.hash_words(pa.array(rows))
    want = [tokens(t) for t in rows]
    assert n.tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    for size in (1, 2, 5):
        own, sizes = words.shingle_sets(pa.array(rows).slice(3), size)
        assert sizes.tolist() == [len(shingles(t, size)) for t in rows[3:]] and len(own) == sizes.sum()
    assert words.hash_words(pa.array([], pa.string()))[0].size == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[k.bit_count() % 2] for k in range(n))


@pytest.mark.parametrize("n", [512, 1000, 1023, 1024, 1025, 2048, 4096])
def test_words_of_two_letters(spark, n):
    import pyarrow as pa

    a, b = thue_morse(n), thue_morse(n, "ba")
    h, counts = words.hash_words(pa.array([f"{a} {b}\n{a.upper()}\t\t", f"{a}a {b}"]))
    assert counts.tolist() == [3, 2] and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    if n in (1024, 2048):
        docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
        scored = kneser_ney.score(docs, kneser_ney.fit(docs.where("doc_id <> 2"))).collect()
        assert {r["doc_id"]: r["n_known"] for r in scored} == {1: 2, 2: 1, 3: 2}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(50)] + [(99, 50), (99, 98), (98, 99)], [(None, 1), (3, 2)]])
def test_components(spark, edges):
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if None not in (a, b) and a != b]
    assert got == roots({x for e in real for x in e}, real)


def test_toxicity_held_out(spark, sf):
    """Found and wrongly accused among the held-out labels."""
    d = sf.replace("0.001", "0.1")
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, d).collect()}
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    assert len(got) == duckdb.sql(f"select count(*) from '{d}/documents.parquet'").fetchall()[0][0]
    held = [(r["predicted"], labels[i]) for i, r in got.items() if r["held_out"] and i in labels]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    toxic, caught = sum(y for _, y in held), sum(p and y for p, y in held)
    assert toxic > 50 and caught >= 0.85 * toxic and caught >= 0.9 * sum(p for p, _ in held)


def test_toxicity_by_brute_force(spark, sf):
    """The features, the optimum and the scores, recomputed plainly from the labelled texts."""
    d = sf.replace("0.001", "0.01")
    rows = [r for r in duckdb.sql(f"select doc_id, text, toxic from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) where toxic is not null order by 1").fetchall() if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = queries.toxicity_model(spark, d)

    def features(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        return words | {w[:n] + "*" for w in words for n in toxicity.BEGINNINGS if len(w) > n} if "*" in next(iter(f for f in model.weights if not f.isalpha()), "*") else set().union(*map(toxicity.word_features, words), set())

    sets, y = [features(t) for _, t, _ in rows], np.array([int(x > 0) for *_, x in rows], float)
    n, pos = Counter(f for s in sets for f in s), Counter(f for s, v in zip(sets, y, strict=True) if v for f in s)
    rate = y.mean()
    z = {f: (pos[f] - c * rate) / math.sqrt(c * rate * (1 - rate) + 1e-9) for f, c in n.items() if c >= toxicity.LEAST_ROWS}
    chosen = sorted((f for f in z if abs(z[f]) >= toxicity.LEAST_Z), key=lambda f: (-abs(z[f]), f))[: toxicity.FEATURES]
    assert set(model.weights) <= set(chosen) and len(model.weights) > 0.9 * len(chosen)
    for (_, t, _), s in list(zip(rows, sets, strict=True))[:200]:
        assert math.isclose(model.score(t), 1 / (1 + math.exp(-np.clip(model.bias + sum(model.weights.get(f, 0.0) for f in s), -30, 30))), rel_tol=1e-9)
    # no small step makes the objective better, so it is the optimum
    w = np.array([model.weights.get(f, 0.0) for f in chosen])
    x = np.array([[f in s for f in chosen] for s in sets], float)
    apart = []
    for (_, t, _), own in zip(rows, x, strict=True):
        other = toxicity.swapped(t) if t else None
        if other is not None:
            delta = own - np.array([f in features(other) for f in chosen], float)
            if delta.any():
                apart.append(delta)
    for group in toxicity.IDENTITY_TERMS:
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                delta = np.array([(f in features(a)) - (f in features(b)) for f in chosen], float)
                if delta.any():
                    apart.append(delta)
    apart = np.array(apart).reshape(-1, len(chosen))

    def objective(w, bias):
        m = x @ w + bias
        return np.mean(np.logaddexp(0, m) - y * m) + toxicity.RIDGE / math.sqrt(len(y)) * (w @ w) / 2 + (toxicity.SAME * np.mean((apart @ w) ** 2) / 2 if len(apart) else 0)

    best, rng = objective(w, model.bias), np.random.default_rng(0)
    for _ in range(50):
        step = rng.normal(0, 0.01, len(w))
        assert objective(w + step, model.bias + rng.normal(0, 0.01)) > best - 1e-7


def test_toxicity_counterfactuals(spark, odd):
    rows = [(i, f"the {g} met {x} ok {i % 7}", int(x == "idiot" or (g == "muslims" and i % 3 == 0))) for i, (g, x) in enumerate([(g, x) for g in ("muslims", "christians") for x in ("idiot", "friends", "people")] * 40)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    a, b = (model.score(f"the {g} met friends ok") for g in ("muslims", "christians"))
    assert abs(a - b) < 0.05 and model.score("idiot") > 0.5 > a
    assert toxicity.swapped("Muslims and men") == "christians and girls" and toxicity.swapped("none") is None
    assert toxicity.score(odd, model, score_col="score").count() == len(ODD)
    assert toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int")).score(None) == 0.5
    assert toxicity.fit(spark.createDataFrame([(None, None, 1), (1, "x", None)], "doc_id long, text string, toxic int")).score("") > 0.5


def base_spans(text):
    text, out = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii(spark, sf, odd):
    for r in queries.op2_pii(spark, sf).collect():
        want = base_spans(dict(texts(sf))[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]
    got = pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32; call (487) 555-7209; 487-555-7209 a@b.c@d.e 1.2.3.256 🙂 x@y.zz")
    assert [g[0] for g in got] == ["iban", "national_phone", "national_phone", "email", "email"]
    assert pii.redact("mail x@y.zz now", pii.find_spans("mail x@y.zz now")) == "mail <EMAIL> now"
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    assert "pii_clean_text" not in pii.annotate(odd, clean_col=None).columns
    rows = pii.annotate(odd).collect()
    assert len(rows) == len(ODD) and rows[0]["pii_clean_text"] is None and set(odd.columns) < set(rows[0].asDict())


def test_pii_base_spans_of_random_texts():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@-+ 0é%23") for _ in range(rng.randrange(40)))
        assert [(k, a, b) for k, a, b, _ in pii.find_spans(text) if k in pii.BASE_KINDS] == base_spans(text)


def test_pii_long_runs():
    for text, n in (("a" * 1_000_000 + "!b@c.de", 1), ("1" * 1_000_000 + ".", 0), ("a@" * 300_000, 0), ("+1" + " " * 1_000_000, 0), ("x@y.zz 487-555-7209 " * 10_000, 10_000)):
        assert sum(s[0] in pii.BASE_KINDS for s in pii.find_spans(text)) == n


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, sf, size):
    rows = texts(sf) + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "solo"), (10**6 + 3, "SOLO"), (10**6 + 4, "a b c d"), (10**6 + 5, "a b c d")]
    sets = [shingles(t, size) for _, t in rows]
    at = {}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    shared_ = Counter((a, b) for v in at.values() for i, a in enumerate(v) for b in v[i + 1 :])
    links = [(rows[a][0], rows[b][0]) for (a, b), n in shared_.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    want = roots([i for i, _ in rows], links)
    for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size).collect():
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
        assert r["n_shingles"] == len(sets[[i for i, _ in rows].index(r["doc_id"])])


def test_setsketch():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.8, 0.95):
        a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        n = int(3000 * 2 * j / (1 + j))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 3000 - n, dtype=np.uint64)])
        ra, rb = (setsketch.registers(x, np.array([len(x)])) for x in (a, b))
        assert abs(setsketch.estimate(ra, rb, np.array([3000.0]), np.array([3000.0]))[0] - j) < 0.12
        both = np.unique(np.concatenate([a, b]))
        assert (setsketch.merge(ra, rb) == setsketch.registers(both, np.array([len(both)]))).all()


def test_near_duplicates_odd(spark, odd):
    rows = setsketch.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (None, None, True), (7, 7, True), (8, 8, True)}
    assert setsketch.near_duplicates(odd.limit(0)).count() == 0
    base, other = [" ".join(f"w{k + j}" for k in range(60)) for j in (0, 500)]
    rows = [(3, base), (5, other), (7, base + " x"), (7, other + " y"), (7, other + " y"), (9, other), (8, "z")] + [(30, "hot row")] * 300 + [(31, "hot row")]
    got = {(r["doc_id"], r["component_id"]) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (9, 3), (8, 8), (30, 30), (31, 30)}


def test_near_duplicates_in_parts(spark, monkeypatch):
    """Buckets larger than a part: chains of texts of which each is only like its neighbours."""
    monkeypatch.setattr(setsketch, "PART_OF_BUCKET", 8)
    rows = [(100 * c + i, " ".join(f"c{c}w{k}" for k in range(3 * i, 3 * i + 100))) for c in range(3) for i in range(40)]
    sets = {i: shingles(t, 1) for i, t in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    for estimated in (True, False):
        got = {r[0]: r["component_id"] for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, estimated=estimated).collect()}
        assert got == want


def test_language_model(spark, sf):
    rows = texts(sf)
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    end, start = ("end",), ("start",)
    single, pair, before = Counter(), Counter(), Counter()
    for _, t in train:
        w = [*tokens(t), end]
        single.update(w)
        pair.update(zip([start, *w], w, strict=False))
        before.update([start, *w[:-1]])
    total, types = sum(single.values()), len(single)
    follows = Counter(w for _, w in pair)
    n = [sum(c == k for c in pair.values()) for k in (1, 2, 3, 4)]
    m = [sum(c == k for c in follows.values()) for k in (1, 2, 3, 4)]
    d, e = kneser_ney.discounts(n), kneser_ney.discounts(m)
    left = {}
    for (u, _), c in pair.items():
        left[u] = left.get(u, 0) + d[min(c, 3) - 1]
    rest = sum(e[min(c, 3) - 1] for c in follows.values()) / len(pair)

    def low(w):
        c = follows[w]
        return max(c - (e[min(c, 3) - 1] if c else 0), 0) / len(pair) + rest / (types + 1)

    def p(u, w):
        if not before[u]:
            return low(w)
        c = pair[u, w]
        return max(c - (d[min(c, 3) - 1] if c else 0), 0) / before[u] + left[u] / before[u] * low(w)

    assert abs(sum(p("the", w) for w in single) + p("the", "unseen-") - 1) < 1e-9
    got = {r["doc_id"]: r for r in queries.op4_language_model(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = [*tokens(t), end]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in single for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((single[x] + 1) / (total + types + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(u, x)) for u, x in zip([start, *w], w, strict=False)), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def kneser_ney_by_hand(train, order):
    """(probability of a word after order - 1 others, as a function) from tokenised texts that end in their end."""
    start, grams = ("start",), [Counter() for _ in range(order + 1)]
    for w in train:
        padded = [start] * (order - 1) + w
        grams[order].update(tuple(padded[i : i + order]) for i in range(len(w)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cuts = [None, *(kneser_ney.discounts([sum(c == n for c in g.values()) for n in (1, 2, 3, 4)]) for g in grams[1:])]
    sums, left = [[Counter() for _ in range(order + 1)] for _ in range(2)]
    for k in range(1, order + 1):
        for g, c in grams[k].items():
            sums[k][g[:-1]] += c
            left[k][g[:-1]] += cuts[k][min(c, 3) - 1]
    types = len(grams[1])

    def p(context, w):
        out = 1 / (types + 1)
        for k in range(1, order + 1):
            h = tuple(context[len(context) - k + 1 :])
            if sums[k][h]:
                c = grams[k][(*h, w)]
                out = max(c - (cuts[k][min(c, 3) - 1] if c else 0), 0) / sums[k][h] + left[k][h] / sums[k][h] * out
        return out

    return p, [w[0] for w in grams[1]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_orders(spark, sf, order):
    rows = texts(sf, "where doc_id < 60")
    end, start = ("end",), ("start",)
    train = [[*tokens(t), end] for i, t in rows if i % 3]
    p, words_ = kneser_ney_by_hand(train, order)
    some = train[0][: order - 1]
    assert abs(sum(p(some, w) for w in words_) + p(some, "unseen-") - 1) < 1e-9
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in kneser_ney.score(frame, kneser_ney.fit(frame.where("doc_id % 3 <> 0"), order=order)).collect()}
    for i, t in rows:
        w = [start] * (order - 1) + [*tokens(t), end]
        want = sum(math.log10(p(w[k - order + 1 : k], w[k])) for k in range(order - 1, len(w)))
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_language_model_odd(spark, odd):
    for docs in (odd, odd.limit(0)):
        rows = kneser_ney.score(odd, kneser_ney.fit(docs)).collect()
        assert len(rows) == len(ODD) and all(math.isfinite(r["score"]) for r in rows) and min(r["n_tokens"] for r in rows) == 1


def test_language_model_large_counts(spark, monkeypatch):
    """Counts that don't fit the table of bigrams stand in one of their own."""
    docs = spark.createDataFrame([(i, "a b a b c" if i % 3 else "b a") for i in range(30)], "doc_id long, text string")
    want = sorted(map(tuple, kneser_ney.score(docs, kneser_ney.fit(docs)).collect()))
    monkeypatch.setattr(kneser_ney, "MANY", 5)
    assert sorted(map(tuple, kneser_ney.score(docs, kneser_ney.fit(docs)).collect())) == want


def test_line_dedup(spark, sf, odd):
    want = duckdb.connect()
    want.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, queries.op5_line_dedup(spark, sf).collect())) == sorted(want.sql(line_dedup.ORACLE).fetchall())
    rows = [(1, "a\nb\nc\nd", "k"), (2, "x\na\nb\nc\nd\ny", "k"), (3, "z\nz\nz\nz\nz", None), (4, "a\nb\nc", "k"), (5, "a\nb", ""), (6, None, ""), (7, "", ""), (None, "a\nb\nc", "")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()}
    assert got == {None: "a\nb\nc", 1: "d", 2: "x\ny", 3: "z\nz\nz", 4: "", 5: "a\nb", 6: None, 7: ""}
    assert line_dedup.dedup_lines(odd, removed_col="key").count() == len(ODD)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0
    long = [(1, "\n".join(["u", *"xy" * 30_000])), (2, "\n".join(["w", *"yx" * 30_000, "v"]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert got == {1: "u\nx\ny\nx", 2: "w\nv"}


def test_warc(spark, sf, tmp_path):
    pages = duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall()
    import base64

    first = {}
    for i, h in sorted(pages):
        first.setdefault(h or "", i)
    got = {r["page_id"]: r for r in queries.op6_warc(spark, sf).collect()}
    assert len(got) == len(pages)
    for i, h in pages:
        b, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) and r["verified"] and r["digest_matches"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    rows = [(1, None, None), (2, "http://a\r\nX: y", ""), (3, "u", "é" * 10), (4, "u", "é" * 10), (4, "u", "é" * 10), (None, "u", "é" * 10), (6, "u", LONG)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", F.lit(0)).withColumn("payload", F.lit(0))
    warc.write_archive(odd, f"{tmp_path}/a")
    records = sorted((warc.parse_records(bytes(r[0]))[0] for r in warc.read_archive(spark, f"{tmp_path}/a").select(warc.record_bytes()).collect()), key=lambda x: x[0]["WARC-Record-ID"])
    assert [(f["WARC-Type"], len(b)) for f, b in records] == [("response", 0), ("revisit", 0), ("response", 20), ("revisit", 0), ("revisit", 0), ("response", len(LONG.encode())), ("revisit", 0)]
    headers = {bytes(r["header"]) for r in warc.read_archive(spark, f"{tmp_path}/a").collect()}
    sha = base64.b32encode(hashlib.sha1(b"").digest()).decode()
    common = f"WARC-Date: {warc.DATE}\r\n"
    assert f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n{common}WARC-Payload-Digest: sha1:{sha}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 0\r\n\r\n".encode() in headers
    revisit = f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:2>\r\n{common}WARC-Target-URI: http://a%0D%0AX: y\r\nWARC-Payload-Digest: sha1:{sha}\r\nWARC-Refers-To: <urn:page:1>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nContent-Length: 0\r\n\r\n"
    assert revisit.encode() in headers
    for _ in range(2):  # a task that runs again replaces its file
        assert warc.write_files(spark, f"{tmp_path}/a", f"file://{tmp_path}/files").agg(F.sum("records")).first()[0] == len(rows)
    written = sorted((f["WARC-Record-ID"], f["WARC-Type"], b) for p in (tmp_path / "files").iterdir() for f, b in warc.parse_records(p.read_bytes()))
    assert written == sorted((f["WARC-Record-ID"], f["WARC-Type"], b) for f, b in records)
    warc.write_archive(odd.limit(0), f"{tmp_path}/b")
    assert warc.read_archive(spark, f"{tmp_path}/b").count() == 0


def reference_ids(rows):
    t = bpe.tokenizer(bpe.vocabulary_path())
    return [(e.ids, t.decode(e.ids, skip_special_tokens=False)) for e in t.encode_batch([x or "" for x in rows], add_special_tokens=False)]


def test_bpe(spark, sf, odd):
    rows = texts(sf)
    want = dict(zip([i for i, _ in rows], reference_ids([t for _, t in rows]), strict=True))
    got = queries.op7_bpe(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, text = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    strange = [*ODD, (9, "a", "e", "s", 1), (9, "don't 'S ''re <|EndOfText|>x<|endoftext|> 3rd x10²,y #\u0301 I\u0307x K \x00\x1f 'tis ''s A'LL\u00a0b\u2028c ß ﬁ Σς 漢字か9 İ, xİy É×÷é œuvre,été! ЙйЁ\u0306 l'État ŉx ǅ e\u0301t Ñ9", "e", "s", 1), *((k, "tok " * (4000 * k), "e", "s", 1) for k in (11, 12, 13)), (14, "w" * 3000 + " x", "e", "s", 1), *[(15, "one row again", "e", "s", 1)] * 50]
    want = sorted((i or 0, *x) for (i, *_), x in zip(strange, reference_ids([o[1] for o in strange]), strict=True))
    frame = spark.createDataFrame(strange, DOCS)
    coded = bpe.encode(frame).withColumn("kept", F.col("ids"))
    assert sorted((r["doc_id"] or 0, r["kept"], r["decoded"]) for r in bpe.decode(coded).collect()) == want
    given = spark.createDataFrame([(1, None, "k"), (2, [], "k"), (3, [320, 10**6, 320], None), (4, [10**6], "k")], "pos int, ids array<int>, piece string")
    one = bpe.pieces()[320]
    assert sorted(map(tuple, bpe.decode(given).collect())) == [(1, "k", None), (2, "k", ""), (3, None, f"{one} {one}"), (4, "k", "")]
    assert bpe.decode(bpe.encode(odd.limit(0))).count() == 0


def test_packing(spark, sf, odd):
    rows = texts(sf)
    want = dict(zip([i for i, _ in rows], [[*ids, 2] for ids, _ in reference_ids([t for _, t in rows])], strict=True))
    placed, seen = {}, {}
    for r in queries.op8_packing(spark, sf).collect():
        own = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert (len(own), zlib.crc32(own.tobytes()), len(want[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, ids in want.items():
        assert sum(n for _, n in seen[d]) == len(ids)
    for p in placed.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert sum(map(len, want.values())) > 0.97 * packing.CAPACITY * len(placed)
    packed = packing.pack(odd, keep_ids=True)
    assert packed.where("start = 0").count() == len(ODD)
    assert packing.sequences(packed).select(F.sum(F.size("ids"))).first()[0] == packed.agg(F.sum("length")).first()[0]
    assert packing.pack(odd.limit(0)).count() == 0
    same = packing.pack(spark.range(20_000).selectExpr("cast(null as long) doc_id", "'one and the same text' text"))
    spread = {r["g"]: r["n"] for r in same.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count("*").alias("n")).collect()}
    assert len(spread) == 5 and max(spread.values()) < 1.2 * packing.GROUP and sum(spread.values()) == 20_000


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 101, 500))[::-1]
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for s, b, o in zip(sizes, bins, offsets, strict=True):
        want = next((i for i, r in enumerate(room) if r >= s), len(room))
        room += [100] * (want == len(room))
        assert (b, o) == (want, 100 - room[want])
        room[want] -= s


VECTORS = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0, 0.0]), (6, [1.0, None, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0, 0.0]), (8, [1.0, 1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (20, [1.0, 0.1, 0.0, 0.0]), (40, [0.0, 1.0, 0.0, 0.0]), (60, [])]


def vectors(sf):
    t = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by 1").fetchall()
    rng = np.random.default_rng(0)
    t += [(10_000 + i, (np.array(v) + rng.normal(0, 0.045, len(v))).astype(np.float32).tolist()) for i, (_, v) in enumerate(t[:60] + t[:20])]
    t += [(20_000 + i, v) for i, (_, v) in enumerate(t[:10] + t[:5])]
    return t


def test_near_vectors(spark, sf):
    rows = vectors(sf)
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = roots(ids, [(ids[a], ids[b]) for a, b in np.argwhere(link)])
    got = {r[0]: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows) and link.sum() > 100
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[k].sum(), want[i], want[i] == i)
    small = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("key", F.lit(1))
    got = {r[0]: tuple(r)[1:] for r in embed_dedup.near_vectors(small).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[None] == (0, None, True) and got[8] == (0, 8, True) and len(got) == len(VECTORS)
    assert embed_dedup.near_vectors(small.limit(0)).count() == 0


def test_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centre = rng.normal(0, 1, 16)
    rows = [(i, (centre + rng.normal(0, 0.3, 16)).tolist()) for i in range(150)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum(1) - 1
    for part, dense, how in ((32, 8, {}), (1024, 8, {}), (32, 10_000, {"bits": 0, "signs": False})):
        monkeypatch.setattr(embed_dedup, "PART", part)
        monkeypatch.setattr(embed_dedup, "DENSE", dense)
        got = {r[0]: r[1] for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **how).collect()}
        assert sum(got[i] != w for i, w in enumerate(want)) <= (0 if how else 2)


def test_near_vectors_odd(spark):
    """Lengths apart, huge and tiny components, ids that several rows have, rows that are there twice."""
    rows = [(3, [1e200, 1e190]), (4, [2e200, 1e190]), (5, None), (5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [0.0, 2.0, 0.0]), (6, [0.0, 2.0, 0.0]), (7, [3.0, 0.0, 0.1]), (8, [1e-200, 0.0, 0.0, 1e-200]), (9, [1e-300, 0.0, 0.0, 1e-300]), (10, [1.0]), (11, [4.0]), (12, [-1.0]), (13, []), (None, [1.0]), (14, [1e308, 1e308, 1e308, 1e308, 1e308]), (15, [1e-308, 1e-308, 1e-308, 1e-308, 1e-308]), (16, [0.0]), (17, [-0.0, 1.0]), (18, [0.0, 1.0])]
    got = sorted(map(tuple, embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id row", "1 key", "2 first")).collect()), key=str)
    want = [(3, 1, 3), (4, 1, 3), (5, 0, 5), (5, 1, 5), (5, 2, 5), (6, 2, 5), (6, 2, 5), (7, 1, 5), (8, 1, 8), (9, 1, 8), (10, 1, 10), (11, 1, 10), (12, 0, 12), (13, 0, 13), (None, 0, None), (14, 1, 14), (15, 1, 14), (16, 0, 16), (17, 1, 17), (18, 1, 17)]
    assert got == sorted(((i, n, c, c is None or c == i) for i, n, c in want), key=str)


def test_spread_join(spark):
    rows = spark.range(3000).selectExpr("if(id < 1000, 0, id) k", "id v")
    one = rows.groupBy("k").agg(F.count("*").alias("members"), F.max("v").alias("m")).where("k % 2 = 0")
    got = components.join_spread(rows, one, ["k"], 3000).collect()
    assert sorted((r["k"], r["v"], r["m"]) for r in got) == sorted((0 if i < 1000 else i, i, 999 if i < 1000 else i) for i in range(3000) if i < 1000 or i % 2 == 0)


def dot(v, w):
    """From the first coordinate to the last; sum() would compensate."""
    total = 0.0
    for p, q in zip(v, w, strict=True):
        total += p * q
    return total


def nearest(rows, k=20):
    """By brute force: {place of the query: [(rank, id, score)]}."""
    out = {}
    for a, (i, v) in enumerate(rows):
        if i is not None and i % 20 == 0 and v:
            found = sorted((-dot(v, w), j, b) for b, (j, w) in enumerate(rows) if b != a and j is not None and w and len(w) == len(v))
            out[a] = [(n + 1, j, -s) for n, (s, j, _) in enumerate(found[:k])]
    return out


def searched(spark, rows, **how):
    index = ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 block", "2 row", "'x' q"))
    return ann.search(index, index.rows.where("id % 20 = 0").selectExpr("id query_id", "vec query", "row own"), **how).collect()


def test_nearest(spark, sf):
    rows = [(i, [float(y) for y in v]) for i, v in vectors(sf)]
    want = nearest(rows)
    for how, least in (({}, 0.95), ({"epsilon": math.inf, "reach": math.inf}, 1)):
        got = searched(spark, rows, **how)
        assert len(got) == sum(map(len, want.values()))
        right = Counter((rows[a][0], *x) for a, w in want.items() for x in w)
        hits = sum((Counter((r["query_id"], r["vec_id"], r["score"]) for r in got) & Counter((q, j, s) for q, _, j, s in right)).values())
        assert hits >= least * len(got)


def test_nearest_odd(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [-1.0, -1.0]), (None, [9.0, 9.0]), (40, [1.0]), (5, [2.0]), (60, None), (80, [0.0, 0.0, 0.0]), (7, [1.0, 1.0, 1.0]), (100, [1e200, 1e200, 1.0, 1.0]), (101, [1e100, 1.0, 1.0, 1e-300]), (102, [1e-200, 1.0, 1.0, 1.0])]
    fine = [(i, v if v and any(v) else None) for i, v in rows]
    want = sorted((fine[a][0], *x) for a, w in nearest(fine).items() for x in w)
    assert sorted(map(tuple, searched(spark, rows))) == want
    assert searched(spark, rows[:1]) == [] and searched(spark, []) == []


def test_nearest_in_clusters(spark, monkeypatch):
    """Many centres, blocks smaller than a cluster, several copies of a block."""
    rng = np.random.default_rng(5)
    mid = rng.normal(0, 3, (12, 24))
    rows = [(int(i), (mid[i % 12] + rng.normal(0, 0.5, 24)).tolist()) for i in range(2400)]
    for name, value in (("BLOCK", 64), ("QUERIES", 8), ("AT_ONCE", 16)):
        monkeypatch.setattr(ann, name, value)
    want = Counter((rows[a][0], j) for a, w in nearest(rows).items() for _, j, _ in w)
    got = Counter((r["query_id"], r["vec_id"]) for r in searched(spark, rows))
    assert sum((want & got).values()) >= 0.95 * sum(want.values()) and sum(got.values()) == sum(want.values())


def test_estimates():
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (400, 100)), rng.normal(0, 1, (50, 100))
    value, bound = ann.estimate(y, *ann.encode(x), epsilon=2.5)
    error = value - y @ x.T
    assert abs(error.mean()) < 0.3 and (np.abs(error) <= bound).mean() > 0.97 and error.std() < 0.8 * (y @ x.T).std()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    """Queries against their SQL."""
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(str(Row(**dict(zip(want.columns, r, strict=True)))) for r in want.fetchall())
