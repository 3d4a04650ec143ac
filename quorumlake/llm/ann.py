"""Nearest neighbours by inner product, from randomly rotated one-bit codes.

Each vector belongs to the nearest of some centres. What remains of it is rotated at random and
coded as the signs of its coordinates, packed, with two scalars: its length and the inner product of
its direction with its code's. A query is rotated too and its coordinates are rounded to PLANES
bits; counting the bits that code and each plane share estimates the inner product without bias,
with an error that a bound holds down with a set probability. Only vectors whose upper bound
reaches what is known of the query's k-th best are ranked by their exact inner products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Standard deviations of the estimate that its bounds allow for, and of a cluster's members that decide whether it is looked into.
EPSILON, REACH = 2.0, 3.6
SEED = 11
#: Bits of a query's coordinates.
PLANES = 6
#: Most rows that centres are fitted on, most centres of a length, and least rows of the sample for a centre: a length with fewer has the centre zero.
SAMPLE_ROWS, CENTRES, LEAST_ROWS = 8192, 1024, 32
#: Rows of a block of the base, about; queries that meet one copy of it; queries estimated at once.
BLOCK, QUERIES, AT_ONCE = 8192, 65536, 64
#: Clusters in which a query's first bound is looked for.
FIRST = 10


def usable(embedding: str):
    """Whether a vector is there, without null or non-finite components, and not zero."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def by_length(batch: pa.RecordBatch | pa.Table, column: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """The rows of each length of the vectors in this column, in their order."""
    if not len(batch):
        return
    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else pc.list_value_length(batch.column(column)).to_numpy()
    known = np.unique(sizes)
    for n in known:
        yield batch if len(known) == 1 else batch.filter(pa.array(sizes == n))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    if dim not in _turns:
        if len(_turns) > 8:
            _turns.clear()
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
        _turns[dim] = q * np.sign(np.diag(r))
    return _turns[dim]


_turns: dict[int, np.ndarray] = {}


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, packed into 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    packed = np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)])
    return np.ascontiguousarray(packed).view(np.uint64)


def encode(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rest: vectors less their centres. (packed bits, length, inner product of its direction with its code's)."""
    turned = rest @ rotation(rest.shape[1])
    length = np.linalg.norm(turned, axis=1)
    agreement = np.abs(turned).sum(1) / np.maximum(length, 1e-300) / math.sqrt(rest.shape[1])
    return _words(turned > 0), length, np.where(length > 0, agreement, 1.0)


def estimate(query: np.ndarray, bits: np.ndarray, length: np.ndarray, agreement: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products of queries with what the codes stand for, half widths of their bounds), by counts of shared bits."""
    dim = query.shape[1]
    turned = query @ rotation(dim)
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    count = np.zeros((len(query), len(bits)), np.int32)
    for p in range(PLANES):
        plane = _words((level >> p) & 1)
        for w in range(bits.shape[1]):
            count += np.bitwise_count(bits[None, :, w] & plane[:, None, w]).astype(np.int32) << p
    ones = np.bitwise_count(bits).sum(1)
    there = step[:, None] * count + low[:, None] * ones
    sums = (step * level.sum(1) + low * dim)[:, None]
    scale = length / agreement / math.sqrt(dim)
    spread = np.sqrt(np.maximum(1 - agreement**2, 0) / max(dim - 1, 1)) * np.linalg.norm(turned, axis=1)[:, None] + step[:, None] / math.sqrt(12)
    return (2 * there - sums) * scale, epsilon * spread * (length / agreement)


@dataclass
class Index:
    """rows: (row, id, vec, dim, cluster, block, bits, length, agreement), in blocks of a cluster; sizes: (dim, cluster, rows, reach); centres by length of vectors."""

    rows: DataFrame
    sizes: DataFrame
    clusters: int
    centres: dict[int, np.ndarray] = field(default_factory=dict)


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """k centres by Lloyd's method from rows that lie apart at random."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    found = x[rng.permutation(len(x))[:k]]
    for _ in range(8):
        to = ((found * found).sum(1)[None, :] / 2 - x @ found.T).argmin(1)
        n = np.bincount(to, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, to, x)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> Index:
    """Code every usable vector (see usable) that has an id, whatever its length.

    Centres are fitted on at most sample_rows rows, those with the smallest hashes, about half the
    square root of the rows in number; a length that the sample has few of gets the centre zero.
    """
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec"), "vectors")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("vec").toArrow()  # sample_rows vectors
    centres: dict[int, np.ndarray] = {}
    for part in by_length(sample, 0):
        own = n * len(part) / max(len(sample), 1)
        k = min(CENTRES, int(math.sqrt(own) / 2), len(part) // LEAST_ROWS)
        x = matrix(part["vec"])
        if k > 1 and len(centres) < 16 and np.isfinite((x * x).sum()):
            centres[x.shape[1]] = _centres(x, k)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, 2):
                for i in range(0, len(part), 4096):
                    own = part.slice(i, 4096)
                    x = matrix(own.column(2))
                    mid = centres.get(x.shape[1], np.zeros((1, x.shape[1])))
                    with np.errstate(all="ignore"):
                        to = ((mid * mid).sum(1)[None, :] / 2 - x @ mid.T).argmin(1)
                        bits, length, agreement = encode(x - mid[to])
                    columns = [pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(to, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(agreement)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *columns], ["row", "id", "vec", "dim", "cluster", "bits", "length", "agreement"])

    codes = cut(rows.mapInArrow(coded, "row long, id long, vec array<double>, dim int, cluster int, bits binary, length double, agreement double"), "codes")
    sizes = codes.groupBy("dim", "cluster").agg(F.count("*").alias("rows"), F.sqrt(F.avg(F.col("length") * F.col("length")) / F.col("dim")).alias("reach"))
    sizes = cut(sizes, "sizes")
    return Index(codes, sizes, sizes.count(), centres)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first coordinate to the last."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def search(index: Index, queries: DataFrame, k: int = 20, epsilon: float = EPSILON, reach: float = REACH) -> DataFrame:
    """queries: (query_id, query array<double>[, own: the row of the index that is no candidate]). Returns (query_id, rank, vec_id, score): the k nearest rows.

    Only vectors of the query's length are compared. Ties go to the smaller id, then the earlier row;
    with fewer than k candidates all are returned; null or unusable queries are left out; repeated ids of queries
    or rows are queries and rows of their own. Scores are exact.

    A query first meets a block of each of its FIRST best clusters: the k-th best score there is a floor.
    It then meets all blocks of each cluster whose centre's score and reach deviations more attain the floor, and
    of those the vectors whose bound attains it are ranked. Blocks travel once for each QUERIES queries that
    meet them, and a task holds one block and one batch of queries. epsilon=reach=math.inf
    looks at all rows.
    """
    own = F.col("own") if "own" in queries.columns else F.lit(None).cast("long")
    asked = queries.where(usable("query")).select(F.monotonically_increasing_id().alias("q"), "query_id", own.cast("long").alias("own"), F.col("query").cast("array<double>").alias("vec"))
    asked = cut(asked, "queries")
    blocks, centres = F.ceil(F.col("rows") / BLOCK).cast("int"), index.centres
    # a row for each cluster; there are few unless very many lengths occur
    small = F.broadcast if index.clusters <= 100_000 else (lambda rows: rows)
    told = index.sizes.where(F.col("dim").isin(*centres)).toArrow() if centres else None  # CENTRES rows for each of at most 16 lengths
    reaches = {d: np.zeros(len(c)) for d, c in centres.items()}
    if told is not None:
        for d, c, r in zip(told["dim"].to_pylist(), told["cluster"].to_pylist(), told["reach"].to_pylist(), strict=True):
            reaches[d][c] = r
    kinds = "q long, query_id long, own long, vec array<double>, floor double, dim int, cluster int, best int"
    names = [x.split()[0] for x in kinds.split(", ")]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_length(batch, 3):
                for i in range(0, len(some), 1024):
                    part = some.slice(i, 1024)
                    x, floor = matrix(part.column(3)), part.column(4).to_numpy()
                    dim = x.shape[1]
                    mid = centres.get(dim, np.zeros((1, dim)))
                    with np.errstate(all="ignore"):
                        score = x @ mid.T
                        most = score + reach * np.linalg.norm(x, axis=1)[:, None] * reaches.get(dim, np.zeros(1)) if math.isfinite(reach) and dim in reaches else np.full(score.shape, np.inf)
                    best = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1, kind="stable")
                    go = (best < FIRST) if dim in reaches else np.ones(score.shape, bool)
                    at, to = np.nonzero(go | (~(most < floor[:, None]) & np.isfinite(floor)[:, None]))
                    columns = part.take(pa.array(at)).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), dim), pa.int32()), pa.array(to, pa.int32()), pa.array(best[at, to], pa.int32())], names)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions sorted so that each copy of a block is followed by its queries."""
        key, held, base = None, [], None
        for batch in batches:
            cuts = np.zeros(len(batch), bool)
            for c in ("dim", "cluster", "block", "copy", "asks"):
                v = batch[c].to_numpy(zero_copy_only=False)
                cuts[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(cuts).tolist(), len(batch)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                now = tuple(part[c][0].as_py() for c in ("dim", "cluster", "block", "copy"))
                if now != key:
                    key, held, base = now, [], None
                if not part["asks"][0].as_py():
                    held.append(part)
                    continue
                if not held and base is None:
                    continue
                if base is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(rows), -1)
                    base, held = (rows["q"].to_numpy(), rows["id"].to_numpy(), matrix(rows["vec"]), bits, rows["length"].to_numpy(), rows["agreement"].to_numpy()), []
                yield from met(base, part, centres[key[0]][key[1]] if key[0] in centres else np.zeros(key[0]))

    def met(base: tuple, asks: pa.RecordBatch, mid: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, ids, x, bits, length, agreement = base
        for i in range(0, len(asks), AT_ONCE):
            part = asks.slice(i, AT_ONCE)
            y, q, floor = matrix(part["vec"]), part["q"].to_numpy(), part["floor"].to_numpy().copy()
            out = rows[None, :] == part["own"].fill_null(-1).to_numpy()[:, None]
            if math.isfinite(epsilon):
                with np.errstate(all="ignore"):
                    value, bound = estimate(y, bits, length, agreement, epsilon)
                    value += (y @ mid)[:, None]
                    low = np.where(out | ~np.isfinite(value - bound), -np.inf, value - bound)
                    first = ~np.isfinite(floor)
                    if first.any() and len(rows) > k:
                        floor[first] = np.partition(low[first], len(rows) - k, axis=1)[:, len(rows) - k]
                    worth = ~(value + bound < floor[:, None]) & ~out
            else:
                worth = ~out
            a, b = np.nonzero(worth)
            score = np.concatenate([np.zeros(0), *(_dots(x[b[s : s + 4096]], y[a[s : s + 4096]]) for s in range(0, len(a), 4096))])
            order = np.lexsort((rows[b], ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            keep = place < k
            a, b = a[keep], b[keep]
            yield pa.RecordBatch.from_arrays([pa.array(q[a]), part["query_id"].take(pa.array(a)), pa.array(ids[b]), pa.array(rows[b]), pa.array(score[keep])], ["q", "query_id", "vec_id", "row", "score"])

    def meet(floors: DataFrame, first: bool) -> DataFrame:
        """The k best of each block for each query that meets it; first: one block of each of the first clusters."""
        places = floors.mapInArrow(probes, kinds)
        if first:
            places = places.where(F.col("best") < FIRST)
        places = places.join(small(index.sizes.select("dim", "cluster", blocks.alias("blocks"))), ["dim", "cluster"])
        copies = places.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))
        mine = F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")
        places = places.join(small(copies), ["dim", "cluster"]).withColumn("block", F.explode(F.array(mine) if first else F.sequence(F.lit(0), F.col("blocks") - 1)))
        asks = places.select("dim", "cluster", "block", F.pmod(F.xxhash64("q", F.lit(1)), F.col("copies")).cast("int").alias("copy"), F.lit(True).alias("asks"), "q", F.col("query_id"), F.lit(None).cast("long").alias("id"), "own", "vec", "floor", F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("double").alias("agreement"))
        rows = index.rows.join(small(index.sizes.select("dim", "cluster", blocks.alias("blocks"))), ["dim", "cluster"]).join(small(copies), ["dim", "cluster"])
        rows = rows.select("dim", "cluster", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("asks"), F.col("row").alias("q"), F.lit(None).cast("long").alias("query_id"), "id", F.lit(None).cast("long").alias("own"), "vec", F.lit(None).cast("double").alias("floor"), "bits", "length", "agreement")
        place = ["dim", "cluster", "block", "copy"]
        return rows.unionByName(asks).repartition(*place).sortWithinPartitions(*place, "asks").mapInArrow(near, "q long, query_id long, vec_id long, row long, score double")

    none = asked.withColumn("floor", F.lit(float("-inf")))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "row")
    seen = meet(none, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
    floors = asked.join(cut(seen, "floors"), "q", "left").select(*asked.columns, F.coalesce("floor", F.lit(-1.7976931348623157e308)).alias("floor"))
    found = meet(floors, False)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
