"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

A word is known by 64 bits of hash. The sorted hashes of the training words, in parts by range, are
the vocabulary; a word's place there is its number. An n-gram's key is made from its words' numbers:
exactly for two words, by 64 bits of hash for more. Keys and counts lie in sorted arrays, in shards
by a hash of the key: no word, however frequent, decides where its n-grams go. All arrays are
files in the shared folder.

Texts begin with order - 1 starts. The highest order counts n-grams; each lower one counts, for an
n-gram, the different words before it among those of the order above. A context has the sum of
the counts after it and how many of them are one, two, or more.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_file, new_folder, write_file
from .words import hash_words, mix

#: The hash of a text's end.
END = mix(np.array([0x656E64], np.uint64))[0]
#: Documents counted or scored at once.
SLICE = 2000
#: Bytes of text for each part of the vocabulary and for each shard of n-grams, about, and the least numbers of both: they follow from the data alone.
PART_BYTES, SHARD_BYTES, LEAST_PARTS, LEAST_SHARDS = 16 << 20, 4 << 20, 8, 32
#: Files that a worker has mapped at most.
MAPS = 16_384
#: A count from here on stands in a table of its own, with 64 bits.
MANY = 2**32 - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _squeeze(a: np.ndarray) -> bytes:
    """A number array in little space: its bytes by place value, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _swell(data: bytes, dtype: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of keys, where each distinct one begins in it)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _packed(columns: list[np.ndarray], values: list[np.ndarray], to: np.ndarray, kind: str) -> list[tuple]:
    """Rows (kind, shard, columns, values, n): for each shard that some row goes to, its rows in the order of their columns."""
    order = np.lexsort([*columns[::-1], to])
    to, columns, values = to[order], [c[order] for c in columns], [v[order] for v in values]
    starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
    out = []
    for a, b in zip(starts, [*starts[1:], len(to)], strict=True):
        first = np.diff(columns[0][a:b].astype(np.int64), prepend=0)
        out.append((kind, int(to[a]), [_squeeze(first.astype("<u4")), *(_squeeze(c[a:b].astype("<u4")) for c in columns[1:])], [_squeeze(v[a:b].astype("<u8")) for v in values], None))
    return out


def _unpacked(table: pa.Table, kind: str, width: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(columns, values) of all rows of a kind."""
    columns, counts = [[np.zeros(0, np.int64)] for _ in range(width)], [[np.zeros(0, np.int64)] for _ in range(values)]
    for k, cs, vs in zip(table["kind"].to_pylist(), table["columns"], table["values"], strict=True):
        if k == kind:
            for j, c in enumerate(cs):
                own = _swell(c.as_py(), "<u4").astype(np.int64)
                columns[j].append(np.cumsum(own) if j == 0 else own)
            for j, v in enumerate(vs):
                counts[j].append(_swell(v.as_py(), "<u8").astype(np.int64))
    return [np.concatenate(c) for c in columns], [np.concatenate(c) for c in counts]


_KINDS = "kind string, shard int, columns array<binary>, values array<binary>, n array<long>"
_SCHEMA = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("columns", pa.list_(pa.binary())), ("values", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with each text's end, tokens of each text)."""
    h, n = hash_words(texts)
    return np.insert(h, np.cumsum(n), END), n + 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts of a partition, about SLICE of them at once."""
    rest: list[pa.Array] = []
    for batch in batches:
        rest.append(batch.column(0))
        if sum(map(len, rest)) >= SLICE:
            yield pa.concat_arrays(rest)
            rest = []
    if sum(map(len, rest)):
        yield pa.concat_arrays(rest)


_opened: OrderedDict[str, np.ndarray] = OrderedDict()


class _Files:
    """The arrays of all parts, each mapped when it is first asked for; of more than MAPS those unused for longest go."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.path, self.dtype = f"{folder}/{name}", dtype

    def __getitem__(self, i: int) -> np.ndarray:
        key = f"{self.path}-{i}"
        if key in _opened:
            _opened.move_to_end(key)
        else:
            if len(_opened) >= MAPS:
                _opened.popitem(last=False)
            _opened[key] = map_file(key, self.dtype)
        return _opened[key]


@dataclass
class Model:
    """folder: where the arrays are. sizes: words in each part of the vocabulary. discounts: three for each order from 1 on."""

    folder: str
    order: int
    parts: int
    shards: int
    sizes: list[int]
    tokens: int
    texts: int
    discounts: list[tuple[float, float, float]]
    low_total: int = 0
    low_types: tuple[int, int, int] = (0, 0, 0)
    many: int = MANY

    @property
    def words(self) -> int:
        return sum(self.sizes)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for unknown ones."""
        known, back = np.unique(h, return_inverse=True)
        out = np.full(len(known), -1, np.int64)
        bounds = np.searchsorted(_part_of(known, self.parts), np.arange(self.parts + 1))
        first = np.concatenate([[0], np.cumsum(self.sizes)])
        files = _Files(self.folder, "words", "<u8")
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            part, own = known[bounds[i] : bounds[i + 1]], files[i]
            if len(own):
                at = np.minimum(np.searchsorted(own, part), len(own) - 1)
                out[bounds[i] : bounds[i + 1]] = np.where(own[at] == part, at + first[i], -1)
        return out[back]

    def firsts(self) -> np.ndarray:
        """The first number of each part; the start of a text is the last number."""
        first = np.concatenate([[0], np.cumsum(self.sizes)])
        first[-1] += 1
        return first

    def _of_words(self, name: str, numbers: np.ndarray, width: int) -> np.ndarray:
        """Rows of a table over the vocabulary and, at its end, the start of a text; zeros for -1."""
        out = np.zeros((len(numbers), width), np.int64)
        order, first = np.argsort(numbers, kind="stable"), self.firsts()
        bounds = np.searchsorted(numbers[order], first)
        files = _Files(self.folder, name, "<i8")
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            at, own = order[bounds[i] : bounds[i + 1]], files[i]
            if len(own):
                out[at] = own.reshape(-1, width)[numbers[at] - first[i]]
        return out

    def key(self, columns: list[np.ndarray]) -> np.ndarray:
        """Keys of n-grams of words' numbers."""
        own = [c.astype(np.uint64) for c in columns]
        h = own[0] if len(own) == 1 else own[0] * np.uint64(self.words + 1) + own[1]
        for c in own[2:]:
            h = mix(mix(h) * _ODD + c)
        return h

    def windows(self, numbers: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """For each token the order - 1 before it, the farthest first, and itself; starts before a text's first."""
        place = np.arange(len(numbers)) - np.repeat(np.cumsum(n) - n, n)
        out = [numbers]
        for d in range(1, self.order):
            before = np.empty_like(numbers)
            before[d:] = numbers[:-d] if d < len(numbers) else numbers[:0]
            before[place < d] = self.words
            out.insert(0, before)
        return out

    def _sharded(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = mix(keys) % np.uint64(self.shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            yield int(i), order[bounds[i] : bounds[i + 1]]

    def _looked_up(self, name: str, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, which of keys it has, their places there)."""
        tables = _Files(self.folder, name, "<u8")
        for i, at in self._sharded(keys):
            own = tables[i]
            if len(own):
                place = np.minimum(np.searchsorted(own, keys[at]), len(own) - 1)
                hit = own[place] == keys[at]
                yield i, at[hit], place[hit]

    def counts(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Counts of n-grams of k words."""
        known, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(known), np.int64)
        counts, large = _Files(self.folder, f"counts{k}", "<u4"), _Files(self.folder, f"large{k}", "<i8")
        for i, at, place in self._looked_up(f"grams{k}", known):
            found = counts[i][place].astype(np.int64)
            if len(large[i]):
                rows, more = large[i].reshape(-1, 2).T
                big = np.flatnonzero(found == self.many)
                found[big] = more[np.searchsorted(rows, place[big])]
            out[at] = found
        return out[back]

    def contexts(self, columns: list[np.ndarray]) -> np.ndarray:
        """For each context: the sum of the counts after it, and how many are one, two, more."""
        if len(columns) == 1:
            return self._of_words("contexts", columns[0], 4)
        k = len(columns) + 1
        known, back = np.unique(self.key(columns), return_inverse=True)
        out = np.zeros((len(known), 4), np.int64)
        values = _Files(self.folder, f"after{k}", "<i8")
        for i, at, place in self._looked_up(f"contexts{k}", known):
            out[at] = values[i].reshape(-1, 4)[place]
        return out[back]

    def low(self, numbers: np.ndarray) -> np.ndarray:
        """Probabilities of words by the number of words that they follow; the rest goes to all words and the unknown one alike."""
        c = self._of_words("follows", numbers, 1)[:, 0]
        if not self.low_total:
            return np.full(len(numbers), 1 / (self.words + 1))
        d = np.array([0.0, *self.discounts[0]])[np.minimum(c, 3)]
        rest = sum(x * n for x, n in zip(self.discounts[0], self.low_types, strict=True)) / self.low_total
        return np.maximum(c - d, 0) / self.low_total + rest / (self.words + 1)

    def log10(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """For each text: tokens, known tokens, log10 of the model's probability and of the add-one unigram's."""
        h, n = _tokens(texts)
        w = self.numbers(h)
        starts = np.cumsum(n) - n
        single = self._of_words("counts", w, 1)[:, 0]
        base = np.log10((single + 1) / (self.tokens + self.words + 1))
        columns, p = self.windows(w, n), self.low(w)
        for k in range(2, self.order + 1):
            own = columns[-k:]
            known = np.all([c >= 0 for c in own[:-1]], axis=0)
            at = np.flatnonzero(known)
            after = self.contexts([c[at] for c in own[:-1]])
            at, after = at[after[:, 0] > 0], after[after[:, 0] > 0]
            c = np.zeros(len(at), np.int64)
            there = w[at] >= 0
            c[there] = self.counts(k, self.key([x[at[there]] for x in own]))
            d = np.array([0.0, *self.discounts[k - 1]])[np.minimum(c, 3)]
            p[at] = np.maximum(c - d, 0) / after[:, 0] + (after[:, 1:] @ np.array(self.discounts[k - 1])) / after[:, 0] * p[at]
        add = np.add.reduceat
        return {"n_tokens": n, "n_known": add((single > 0).astype(np.int64), starts), "score": add(np.log10(p), starts), "base_score": add(base, starts)}


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of types seen once, twice, thrice and four times; halves where the data don't tell."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    out = []
    for k in range(3):
        d = k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else (k + 1) / 2
        out.append(float(min(max(d, 0.05), k + 0.95)))
    return out[0], out[1], out[2]


def fit(docs: DataFrame, text_col: str = "text", order: int = 3) -> Model:
    """Count all texts of docs (null: empty); a text's end is a token. Without rows every word is unknown.

    order: words in an n-gram, two at least. A bigram's key has 64 bits for two word numbers, so more than 4.2e9
    distinct words are an error.
    """
    if order < 2:
        raise ValueError("an order below two")
    spark = docs.sparkSession
    folder = new_folder(spark, "ngrams")
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, shards = max(LEAST_PARTS, -(-size // PART_BYTES)), max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    tasks = -(-shards // 2)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            h, n = np.unique(_tokens(part)[0], return_counts=True)
            bounds = np.searchsorted(_part_of(h, parts), np.arange(parts + 1))
            full = np.flatnonzero(np.diff(bounds))
            cut = [(int(bounds[k]), int(bounds[k + 1])) for k in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([_squeeze(h[a:b]) for a, b in cut], pa.binary()), pa.array([_squeeze(n[a:b].astype("<u4")) for a, b in cut], pa.binary()), pa.array([len(part) * (k == full[0]) for k in full], pa.int64())], ["part", "keys", "counts", "texts"]
            )

    def words_of(table: pa.Table) -> pa.Table:
        k = table["part"][0].as_py()
        h = np.concatenate([_swell(x.as_py(), "<u8") for x in table["keys"]])
        order_, starts = _grouped(h)
        n = np.add.reduceat(np.concatenate([_swell(x.as_py(), "<u4") for x in table["counts"]]).astype(np.int64)[order_], starts)
        h = h[order_][starts]
        write_file(f"{folder}/words-{k}", h.astype("<u8").tobytes())
        write_file(f"{folder}/counts-{k}", n.astype("<i8").tobytes())
        return pa.table({"part": pa.array([k], pa.int32()), "words": [len(h)], "tokens": [int(n.sum())], "texts": [sum(table["texts"].to_pylist())]})

    # one short row for each part
    made = {r["part"]: r for r in texts.mapInArrow(singles, "part int, keys binary, counts binary, texts long").repartition(parts, "part").groupBy("part").applyInArrow(words_of, "part int, words long, tokens long, texts long").collect()}
    sizes = [made[k]["words"] if k in made else 0 for k in range(parts)]
    if sum(sizes) + 1 >= 2**32:
        raise OverflowError("too many distinct words for bigram keys of 64 bits")
    model = Model(folder, order, parts, shards, sizes, sum(r["tokens"] for r in made.values()), sum(r["texts"] for r in made.values()), [(0.5, 1.0, 1.5)] * order, many=MANY)
    first = model.firsts()

    def to_shards(columns: list[np.ndarray]) -> np.ndarray:
        """Where n-grams go: single words to their part of the vocabulary, others to the shard of their key."""
        if len(columns) == 1:
            return np.searchsorted(first, columns[0], "right") - 1
        return (mix(model.key(columns)) % np.uint64(model.shards)).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            h, n = _tokens(part)
            columns = model.windows(model.numbers(h), n)
            ranked, starts = _grouped(model.key(columns))
            columns = [c[ranked[starts]] for c in columns]
            yield from _table(_packed(columns, [np.diff(np.append(starts, len(ranked)))], to_shards(columns), "gram")).to_batches()

    def level(k: int):
        def run(table: pa.Table) -> pa.Table:
            s = table["shard"][0].as_py()
            if s < 0:  # how many types of an order have a count of one to four
                return _table([("types", s, [], [], np.array(table["n"].to_pylist()).sum(0).tolist())])
            columns, (counts,) = _unpacked(table, "gram", k, 1)
            keys = model.key(columns)
            ranked, starts = _grouped(keys)
            columns = [c[ranked[starts]] for c in columns]
            counts = np.add.reduceat(counts[ranked], starts) if len(starts) else counts
            write_file(f"{folder}/grams{k}-{s}", keys[ranked[starts]].astype("<u8").tobytes())
            write_file(f"{folder}/counts{k}-{s}", np.minimum(counts, model.many).astype("<u4").tobytes())
            large = np.flatnonzero(counts >= model.many)
            write_file(f"{folder}/large{k}-{s}", np.stack([large, counts[large]], 1).astype("<i8").tobytes())
            if k < order:
                before, after = _unpacked(table, "context", k, 4)
                keys = model.key(before)
                ranked, starts = _grouped(keys)
                sums = [np.add.reduceat(v[ranked], starts) if len(starts) else v for v in after]
                write_file(f"{folder}/contexts{k + 1}-{s}", keys[ranked[starts]].astype("<u8").tobytes())
                write_file(f"{folder}/after{k + 1}-{s}", np.stack(sums, 1).astype("<i8").tobytes())
            rows = [("types", -k, [], [], [int((counts == c).sum()) for c in (1, 2, 3, 4)])]
            for kind, part in (("context", columns[:-1]), ("gram", columns[1:])):
                ranked, starts = _grouped(model.key(part))
                if len(starts):
                    own = counts[ranked]
                    values = [own, own == 1, own == 2, own > 2] if kind == "context" else [np.ones(len(own), np.int64)]
                    part = [c[ranked[starts]] for c in part]
                    rows += _packed(part, [np.add.reduceat(v.astype(np.int64), starts) for v in values], to_shards(part), kind)
            return _table(rows)

        return run

    def tables_of(table: pa.Table) -> pa.Table:
        kind, k = table["kind"][0].as_py(), table["shard"][0].as_py()
        if kind == "types":
            return _table([(kind, k, [], [], np.array(table["n"].to_pylist()).sum(0).tolist())])
        width = 4 if kind == "context" else 1
        (numbers,), values = _unpacked(table, kind, 1, width)
        out = np.zeros((int(first[k + 1] - first[k]), width), np.int64)
        for j, v in enumerate(values):
            np.add.at(out[:, j], numbers - first[k], v)
        write_file(f"{folder}/{'contexts' if kind == 'context' else 'follows'}-{k}", out.astype("<i8").tobytes())
        n = [] if kind == "context" else [int(out.sum()), *(int((out == c).sum()) for c in (1, 2, 3, 4)), int((out > 2).sum())]
        return _table([(kind, k, [], [], n)])

    rows = texts.mapInArrow(counted, _KINDS)
    for k in range(order, 1, -1):
        rows = rows.repartition(tasks, "shard").groupBy("shard").applyInArrow(level(k), _KINDS)
    # a few numbers for each part
    told = rows.repartition(parts, "kind", "shard").groupBy("kind", "shard").applyInArrow(tables_of, _KINDS).select("kind", "shard", "n").collect()
    low = np.array([r["n"] for r in told if r["kind"] == "gram"]).sum(0).tolist() if told else []
    if low:
        model.discounts = [discounts(low[1:5]), *(discounts(next(r["n"] for r in told if r["kind"] == "types" and r["shard"] == -k)) for k in range(2, order + 1))]
        model.low_total, model.low_types = low[0], (low[1], low[2], low[5])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col long, n_tokens, n_known long, base_score, score, perplexity double): a row per row of docs.

    score is the log10 probability of the whole text and its end; a null or empty text is the end alone.
    Ids may be null or repeated; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                part = batch.slice(i, SLICE)
                got = model.log10(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c]) for c in ("n_tokens", "n_known", "base_score", "score"))], ["id", "n_tokens", "n_known", "base_score", "score"])

    out = rows.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
