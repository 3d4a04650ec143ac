"""A toxicity classifier whose scores don't hang on which group a text names.

Logistic regression over the presence of words and word beginnings. Besides the log loss it is
fitted on counterfactuals: labelled texts with their identity terms swapped for others of the
same kind, whose scores may not differ from the original's. That keeps mere mentions of a group
from becoming evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, release

#: Terms of one line can stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
#: Most labelled rows a model is fitted on; of more, those with the smallest hashes of their ids are used.
SAMPLE_ROWS = 20_000
#: Size of the model, and of the beginnings of words that are features beside whole words.
FEATURES, BEGINNINGS = 512, (4, 5, 6)
LEAST_ROWS, LEAST_Z = 6, 4.0
RIDGE, SAME = 0.02, 50.0

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)} if text else set()


def swapped(text: str, terms=IDENTITY_TERMS) -> str | None:
    """The text, lower-cased, with each identity term replaced by the next of its kind; None without any."""
    after = {a: g[(i + 1) % len(g)] for g in terms for i, a in enumerate(g)}
    low = text.lower()
    out = _WORD.sub(lambda m: after.get(m.group(), m.group()), low)
    return out if out != low else None


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        """Probability that the text is toxic; an empty or null one has the prior's."""
        total = self.bias
        if text:
            if len(self._known) > 500_000:
                self._known.clear()
            on: set[str] = set()
            for w in set(_WORD.findall(text.lower())):
                found = self._known.get(w)
                if found is None:
                    found = self._known[w] = tuple(f for f in word_features(w) if f in self.weights)
                if found:
                    on.update(found)
            total += sum(self.weights[f] for f in sorted(on))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def solve(x: np.ndarray, y: np.ndarray, differences: np.ndarray) -> tuple[float, np.ndarray]:
    """(bias, weights) of least mean log loss + RIDGE/2 |w|^2 / n + SAME/2 * mean (difference . w)^2, by Newton's steps."""
    n, d = x.shape
    w = np.zeros(d + 1)
    one = np.hstack([x, np.ones((n, 1), x.dtype)])
    penalty = np.zeros((d + 1, d + 1))
    penalty[np.arange(d), np.arange(d)] = RIDGE / np.sqrt(max(n, 1))
    if len(differences):
        penalty[:d, :d] += SAME * (differences.T @ differences) / len(differences)
    rate = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    w[d] = np.log(rate / (1 - rate))
    if not n or y.min() == y.max():
        return float(w[d]), w[:d]

    def loss(v: np.ndarray) -> float:
        z = one @ v
        return float(np.mean(np.logaddexp(0, z) - y * z) + v @ penalty @ v / 2)

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        slope = one.T @ (p - y) / n + penalty @ w
        bend = (one * (p * (1 - p))[:, None]).T @ one / n + penalty + 1e-9 * np.eye(d + 1)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-4 and (after := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4:
            break
        w -= size * step
        if now - after < 1e-9:
            break
        now = after
    return float(w[d]), w[:d]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows, sample_rows of them at most. Rows with a null label are left out; null texts are empty; without rows the prior is 0.5."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.col(label_col) > 0).cast("int").alias("y"))
    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    if not totals["n"]:
        return Model(0.0, {})
    part = min(1.0, sample_rows / totals["n"])
    rows = cut(rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(part * (1 << 30))), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                seen = [Counter(), Counter()]
                n = [0, 0]
                for t, y in zip(batch.column(1).slice(i, 2000).to_pylist(), batch.column(2).slice(i, 2000).to_pylist(), strict=True):
                    seen[y].update(text_features(t))
                    n[y] += 1
                names = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_pydict({"f": [*names, ""], "pos": [*(seen[1][f] for f in names), n[1]], "neg": [*(seen[0][f] for f in names), n[0]]})
        release()

    found = rows.mapInArrow(counted, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # what is rarer than LEAST_ROWS, or as frequent in both classes as chance would have it, is no feature
    pos, n = totals["pos"] / totals["n"], F.col("pos") + F.col("neg")
    z = (F.col("pos") - n * pos) / F.sqrt(n * (pos * (1 - pos)) + 1e-9)
    chosen = found.where((F.col("f") != "") & (n >= LEAST_ROWS)).withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "f").limit(FEATURES)
    features = sorted(r["f"] for r in chosen.collect())
    place = {f: i for i, f in enumerate(features)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(t: str | None) -> list[int]:
            return sorted(place[f] for f in text_features(t) if f in place)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            other = [swapped(t) if t else None for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([of(t) for t in texts], pa.list_(pa.int32())), pa.array([None if o is None else of(o) for o in other], pa.list_(pa.int32()))], ["id", "y", "x", "swap"]
            )

    got = sorted(rows.mapInArrow(indexed, "id long, y int, x array<int>, swap array<int>").collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["y"]))  # sample_rows short lists at most
    x, differences = np.zeros((len(got), len(features)), np.float32), []
    for i, r in enumerate(got):
        x[i, r["x"]] = 1
        if r["swap"] is not None and r["swap"] != r["x"]:
            d = x[i].copy()
            d[r["swap"]] -= 1
            differences.append(d)
    # and each pair of terms of a kind on its own, so that terms which no labelled text has are held too
    for group in IDENTITY_TERMS:
        for a, b in combinations(group, 2):
            d = np.zeros(len(features), np.float32)
            for term, sign in ((a, 1), (b, -1)):
                for f in word_features(term):
                    if f in place:
                        d[place[f]] += sign
            if d.any():
                differences.append(d)
    bias, w = solve(x, np.array([r["y"] for r in got], np.float64), np.array(differences, np.float64).reshape(len(differences), len(features)))
    return Model(bias, {f: float(v) for f, v in zip(features, w, strict=True) if v})


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with score_col double; all rows and other columns stay, a column of that name is replaced. Only the text is looked at, whole."""
    names = [c for c in docs.columns if c != score_col]
    own = docs.select(*names)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.score(t) for t in batch.column(at).to_pylist()], pa.float64())], [*names, score_col])
        release()

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{kinds}, `{score_col}` double")
