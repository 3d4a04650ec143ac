"""Near-duplicate documents by SetSketch registers.

A register holds the smallest of exponentially distributed values of a set's elements on a
logarithmic scale of base BASE, truncated to 16 bits: larger for more elements. Registers of a
union are the maxima of both sets' registers, and equal registers are as likely as the
sets are alike. Bands of registers propose pairs, a joint maximum-likelihood estimate
drops those that are clearly less alike, and the full sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, join_spread
from .shared import cut, map_file, new_folder, release, writing
from .units import groups, pairs, units
from .words import mix, shingle_sets

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535

_rng = np.random.Generator(np.random.PCG64(77))
_FLIP = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_ODD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of a bucket that are compared with each other at once.
PART_OF_BUCKET = 256
#: Set elements worked on at once, and pairs.
PART, PAIRS = 1 << 15, 8192
#: Bytes of full sets in a part of their store, at most about, and at least where there are fewer parts than the session shuffles into.
MOST_BYTES, LEAST_BYTES = 64 << 20, 4 << 20


def registers(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """REGISTERS values for each non-empty set; elements holds the sets one after the other."""
    least = np.empty((len(sizes), REGISTERS), np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PART, "right")) - 1)
        part, at = elements[starts[i] : starts[j]], starts[i:j] - starts[i]
        own = np.empty_like(part)
        for k in range(REGISTERS):
            np.bitwise_xor(part, _FLIP[k], out=own)
            np.multiply(own, _ODD[k], out=own)
            least[i:j, k] = np.minimum.reduceat(own, at)
        i = j
    value = -np.log1p(-np.minimum((least.astype(np.float64) + 1) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates of the Jaccard similarity of pairs of sets, whose sizes are known.

    a, b: registers, a row for each pair.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = [np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12) for x in (u - v * j, v - u * j)]
        return more * np.log(p[0]) + less * np.log(p[1]) + same * np.log(np.maximum(1 - p[0] - p[1], 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one maximum
        x, y = low + (high - low) * 0.382, low + (high - low) * 0.618
        up = likelihood(x) < likelihood(y)
        low, high = np.where(up, x, low), np.where(up, high, y)
    return (low + high) / 2


def lowest_estimate(threshold: float) -> float:
    """Pairs as alike as the threshold are estimated below this once in some millions."""
    return threshold - 5.2 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _digests(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits that tell sets apart, as two rows; 0 for empty sets."""
    out = np.zeros((2, len(sizes)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        for k in range(2):
            out[k, full] = np.add.reduceat(mix(elements ^ np.uint64(0x5851F42D4C957F2D * (k + 1) % 2**64)), at)
    return out.view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs: (id long, text). Returns (id, n, d1, d2, regs): set size, 128 bits that tell sets apart, registers (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                elements, sizes = shingle_sets(part.column(1), shingle)
                full = np.flatnonzero(sizes)
                regs: list[bytes | None] = [None] * len(part)
                if len(full):
                    for d, r in zip(full, registers(elements, sizes[full]).astype(">u2"), strict=True):
                        regs[d] = r.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *map(pa.array, _digests(elements, sizes)), pa.array(regs, pa.binary())], ["id", "n", "d1", "d2", "regs"])
        release()

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, regs binary")


@dataclass
class Sets:
    """Full sets by id, as sorted arrays in the shared folder that workers map into memory."""

    folder: str
    parts: int

    def of(self, id_: int) -> list[np.ndarray]:
        """The sets of the texts that have this id."""
        part = int(mix(np.array([id_]).view(np.uint64))[0] % np.uint64(self.parts))
        ids, ends, elements = _mapped(self.folder, part)
        low, high = np.searchsorted(ids, [id_, id_ + 1])
        return [elements[ends[k - 1] if k else 0 : ends[k]] for k in range(low, high)]


_opened: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _mapped(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if (folder, part) not in _opened:
        if len(_opened) > 4096:
            _opened.clear()
        _opened[folder, part] = (map_file(f"{folder}/ids-{part}", "<i8"), map_file(f"{folder}/ends-{part}", "<i8"), map_file(f"{folder}/elements-{part}", "<u8"))
    return _opened[folder, part]


def store_sets(docs: DataFrame, shingle: int, elements: int) -> Sets:
    """docs: (id long, text), ids not null; elements: how many their sets have in all. Writes each part's sets in the order of ids.

    The number of parts follows from the elements; a part is written as its rows come, so no task holds one.
    """
    spark = docs.sparkSession
    parts = max(-(-8 * elements // MOST_BYTES), min(-(-8 * elements // LEAST_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    sets = Sets(new_folder(spark, "sets"), parts)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # of a repeated row each partition sends one
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                elements, sizes = shingle_sets(part.column(1), shingle)
                ends, ids = np.cumsum(sizes), part.column(0).to_numpy()
                to = (mix(ids.view(np.uint64)) % np.uint64(sets.parts)).astype(np.int32)
                names = list(zip(ids.tolist(), *_digests(elements, sizes).tolist(), strict=True))
                new = [k for k, name in enumerate(names) if name not in seen and not seen.add(name)]
                yield pa.RecordBatch.from_arrays([pa.array(to[new]), pa.array(ids[new]), pa.array([elements[ends[k] - sizes[k] : ends[k]].tobytes() for k in new], pa.binary())], ["part", "id", "elements"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)

        from itertools import groupby

        for k, rows in groupby(own(), lambda r: r[0]):
            ids, ends, end = [], [], 0
            with writing(f"{sets.folder}/elements-{k}") as f:
                for _, id_, blob in rows:
                    data = blob.as_buffer()
                    f.write(data)
                    end += data.size // 8
                    ids.append(id_)
                    ends.append(end)
            for name, values in (("ids", ids), ("ends", ends)):
                with writing(f"{sets.folder}/{name}-{k}") as f:
                    f.write(np.array(values, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32())})

    rows = docs.mapInArrow(made, "part int, id long, elements binary").repartition(parts, "part").sortWithinPartitions("part", "id")
    rows.mapInArrow(written, "part int").agg(F.count("*")).first()
    return sets


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").astype(np.uint16).reshape(len(column), REGISTERS)


def confirmed(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, nx: np.ndarray, ny: np.ndarray, sets: Sets, percent: int, estimated: bool) -> np.ndarray:
    """Which of the pairs are links: by estimate, if wanted, then by their full sets."""
    ok = estimate(rx, ry, nx.astype(np.float64), ny.astype(np.float64)) >= lowest_estimate(percent / 100) if estimated else np.ones(len(x), bool)
    for k in np.flatnonzero(ok):
        ok[k] = any(alike(a, b, percent) for a in sets.of(int(x[k])) for b in sets.of(int(y[k])))
    return ok


def _stars(proposed: DataFrame, cards: DataFrame, sets: Sets, percent: int, estimated: bool) -> DataFrame:
    """The links among the proposed pairs (x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y, nx, ny = (batch.column(c).to_numpy() for c in (0, 1, 4, 5))
                yield batch.select([0, 1]).filter(pa.array(confirmed(x, y, _as_registers(batch.column(2)), _as_registers(batch.column(3)), nx, ny, sets, percent, estimated)))

    one, two = (cards.select(F.col("rep").alias(c), F.col("regs").alias(f"r{c}"), F.col("n").alias(f"n{c}")) for c in "xy")
    return proposed.join(one, "x").join(two, "y").select("x", "y", "rx", "ry", "nx", "ny").mapInArrow(run, "x long, y long")


def _across(now: DataFrame, rows: int, cards: DataFrame, sets: Sets, percent: int, estimated: bool) -> DataFrame:
    """now: (key, band, rep, component, members); rows: how many its units will have. The links between members of a bucket in different components.

    A bucket is dealt into parts and each pair of parts is one unit of work; only links leave it. A pair
    is looked at in the first band that brings it together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in groups(batches):
            reps, tied, n, band = (some[c].to_numpy() for c in ("rep", "component", "n", "band"))
            regs = _as_registers(some["regs"])
            for a, b in pairs(some, 64 * PAIRS):
                apart = tied[a] != tied[b]
                a, b = a[apart], b[apart]
                for k in range(0, len(a), PAIRS):
                    x, y = a[k : k + PAIRS], b[k : k + PAIRS]
                    first = (regs[x] == regs[y]).reshape(len(x), BANDS, ROWS).all(2).argmax(1) == band[x]
                    x, y = x[first], y[first]
                    ok = confirmed(reps[x], reps[y], regs[x], regs[y], n[x], n[y], sets, percent, estimated)
                    if ok.any():
                        yield pa.RecordBatch.from_pydict({"x": reps[x[ok]], "y": reps[y[ok]]})

    # few bytes and much work, so the number of tasks goes by rows
    tasks = max(int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 20_000)
    live = units(now.join(cards, "rep").withColumnRenamed("rep", "id"), PART_OF_BUCKET).withColumnRenamed("id", "rep")
    dealt = live.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "part")
    return dealt.select("key", "i", "j", "part", "band", "rep", "component", "n", "regs").mapInArrow(run, "x long, y long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, estimated: bool = True) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their sets of word shingles.

    Returns a row per row of docs: (id_col, n_shingles long, component_id long, kept boolean). The
    component is the smallest id reachable; kept marks the row that has this id. Documents without
    words (null text included) are linked with nothing. Rows with a null id are linked with nothing
    and kept, component null. Rows that share an id are one node with several texts: links of each
    tie it, and n_shingles is each row's own. Extra columns are ignored.

    Links are exact. A pair at the threshold shares no band with probability 3e-6 (at 80 percent), and
    its estimate is too low once in some millions; estimated=False compares the full sets of all pairs of a bucket.

    Equal sets are one class. Within a bucket of a band, classes are first compared with two of
    its members; what is then still in different components is compared block by block, so large
    buckets of much alike texts never make all their pairs, and no pair of a bucket is left out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = cut(sketches(texts, shingle), "sketches")
    keys = ["d1", "d2", "n"]
    full = seen.where("n > 0 and id is not null")
    classes = cut(full.groupBy(*keys).agg(F.min("id").alias("rep"), F.first("regs").alias("regs"), F.count("*").alias("members")), "classes")
    size = 2 * ROWS
    bands = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * size + 1, F.lit(size))))).alias("band", "key"))
    hubs = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("hub"), F.min_by("rep", F.xxhash64("rep")).alias("other")).where("members > 1").drop("members")
    live = cut(bands.join(hubs, "key"), "buckets")
    # stored, so that its size is known before it is joined: while that is small no text is shuffled
    wanted = cut(live.select("rep").distinct(), "wanted")
    cards = cut(classes.join(wanted, "rep", "left_semi").select("rep", "n", "regs"), "cards")
    sets = store_sets(texts.join(wanted.withColumnRenamed("rep", "id"), "id", "left_semi"), shingle, cards.agg(F.sum("n")).first()[0] or 0)

    def stars(hub: str) -> DataFrame:
        return live.where(f"rep <> {hub}").select(F.col("rep").alias("x"), F.col(hub).alias("y"))

    # an id with texts of several classes ties them
    total = full.count()
    several = cut(full.groupBy("id").agg(F.count("*").alias("members"), F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi")).where("lo <> hi").select("id", "members"), "several")
    # first each class against two of its bucket, then all that is in one bucket and still apart
    links = _stars(stars("hub").unionByName(stars("other")).distinct(), cards, sets, percent, estimated)
    if not several.isEmpty():
        of_several = join_spread(full.select("id", *keys), several, ["id"], total).drop("members")
        links = links.unionByName(join_spread(of_several, classes.select(*keys, "rep", "members"), keys, total).select(F.col("id").alias("x"), F.col("rep").alias("y")))
    links = cut(links, "links")

    def tied(links: DataFrame) -> DataFrame:
        return cut(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "components")

    found = tied(links)
    now = live.select("key", "band", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    apart = cut(now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("key", "members"), "apart")
    rows = apart.agg(F.sum(F.col("members") * F.ceil(F.col("members") / PART_OF_BUCKET))).first()[0] or 0
    more = cut(_across(now.join(apart, "key"), rows, cards, sets, percent, estimated).distinct(), "links")
    if not more.isEmpty():
        found = tied(links.unionByName(more))
    first = classes.drop("regs").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*keys, "members", F.coalesce("component", "rep").alias("component"))
    members = join_spread(full.select("id", *keys), cut(first, "classes"), keys, total).select("id", "n", "component")
    rest = seen.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return members.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )


#: For two-word shingles and 80 percent.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
sh as (select distinct doc_id, unnest(case len(ws) when 0 then [] when 1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) s from w),
n as (select doc_id, count(*) n from sh group by doc_id),
shared_ as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from shared_ join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
ends as (select x a, y b from links union all select y, x from links),
reach(a, b) as (select a, b from ends union select r.a, e.b from reach r join ends e on e.a = r.b),
least_ as (select a, min(b) m from reach group by a)
select w.doc_id, coalesce(n.n, 0) n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) component_id, w.doc_id <= coalesce(m, w.doc_id) kept
from w left join n on n.doc_id = w.doc_id left join least_ on a = w.doc_id
"""
