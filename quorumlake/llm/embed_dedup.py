"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import by_length, matrix, usable
from .components import components, join_spread
from .shared import cut
from .units import groups, pairs, units

#: A pair at the threshold shares no bucket with this probability; tables are as many as that takes.
MISSED = 2e-4
#: Members of a bucket that are compared with each other at once; a larger bucket is dealt into parts, and each pair of parts is a unit.
PART = 1024
#: Bits of a second code: a pair whose codes differ in more of them than most_differing() is not compared exactly.
SIGNED = 256
#: Pairs compared at once; groups of more than DENSE vectors are multiplied as matrices.
PAIRS, DENSE = 1 << 16, 96
SEED = 5


def plan(n: int, threshold: float, missed: float = MISSED) -> tuple[int, int]:
    """(tables, bits) for n vectors: bits grow with log n, so that buckets of unlike vectors stay small, and tables with bits, so that none more is missed."""
    bits = min(40, max(10, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(missed) / math.log1p(-agree)), bits


def most_differing(threshold: float) -> int:
    """Six standard deviations over what is expected at the threshold."""
    p = np.arccos(threshold) / np.pi
    return int(np.ceil(SIGNED * p + 6 * np.sqrt(SIGNED * p * (1 - p))))


def codes(vectors: DataFrame, tables: int, bits: int) -> DataFrame:
    """vectors: (id, vec). Returns (id, codes: a number of bits bits for each table, sign: SIGNED bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for part in by_length(batch, 1):
                for i in range(0, len(part), 2000):
                    own = part.slice(i, 2000)
                    x = matrix(own.column(1))
                    x = (x / np.abs(x).max(1, keepdims=True)).astype(np.float32)
                    dim = x.shape[1]
                    if dim not in planes:
                        planes = {dim: np.random.Generator(np.random.PCG64(SEED)).standard_normal((dim, SIGNED + tables * bits)).astype(np.float32)}
                    above = x @ planes[dim] > 0
                    sign = np.packbits(above[:, :SIGNED], axis=1)
                    code = (above[:, SIGNED:].reshape(len(x), tables, bits) @ powers).ravel() if bits else np.zeros(len(x) * tables, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(code, pa.int64()))
                    yield pa.RecordBatch.from_arrays([own.column(0), lists, pa.array([r.tobytes() for r in sign], pa.binary())], ["id", "codes", "sign"])

    return vectors.mapInArrow(run, "id long, codes array<long>, sign binary")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by a power of two first, so no square over- or underflows that matters."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, missed: float = MISSED, bits: int | None = None, signs: bool = True) -> DataFrame:
    """Links of cosine >= threshold (in double precision) and their components.

    Returns a row per row of vectors: (id_col, n_links long: other rows linked directly, component_id long:
    smallest id reachable, kept boolean). Vectors that are null, empty, zero or hold null or non-finite
    components are linked with nothing; so are vectors of different lengths with each other. Rows with
    a null id are linked with nothing and kept. Rows that share an id are one node with several vectors:
    links of each tie it, n_links is each row's own. Equal vectors are one class, whose size counts for
    each link. Other columns are ignored.

    What is returned is exact; a pair at the threshold is not found with probability missed by the
    tables and 1e-9 by the second code (signs=False leaves that out). bits=0 compares all pairs of a
    length. A pair is counted in the first table that brings it together, so no list of pairs is made.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable(vector_col), F.col(vector_col).cast("array<double>")).alias("vec"))
    rows = cut(given.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")
    keys = ["dim", "d1", "d2"]
    good = rows.where("vec is not null and id is not null").select("row", "id", F.size("vec").alias("dim"), F.xxhash64("vec").alias("d1"), F.xxhash64(F.lit(1), F.col("vec")).alias("d2"))
    classes = cut(good.groupBy(*keys).agg(F.min("id").alias("first"), F.min("row").alias("rep"), F.count("*").alias("members")), "classes")
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first()
    tables, bits = (1, 0) if bits == 0 else plan(n, threshold, missed) if bits is None else (math.ceil(math.log(missed) / math.log1p(-((1 - math.acos(threshold) / math.pi) ** bits))), bits)
    reps = rows.join(classes.select(F.col("rep").alias("row"), "first", F.col("members").alias("weight")), "row").select(F.col("row").alias("id"), "vec", "first", "weight")
    coded = cut(codes(reps.select("id", "vec"), tables, bits), "codes")
    spread = coded.join(reps.select("id", F.size("vec").alias("dim")), "id").select("id", "sign", "dim", F.posexplode("codes").alias("t", "c")).select(F.xxhash64("dim", "t", "c").alias("key"), "t", "id", "sign")
    full = spread.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    most = most_differing(threshold) if signs else SIGNED
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * tables // 200_000)

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, id) of what has another member of its unit with few other bits."""
        for some in groups(batches):
            sign = np.frombuffer(b"".join(some["sign"].to_pylist()), np.uint64).reshape(len(some), -1)
            hit = np.zeros(len(some), bool)
            for a, b in pairs(some, PAIRS * 4):
                near = np.bitwise_count(sign[a] ^ sign[b]).sum(1, dtype=np.int64) <= most
                hit[a[near]] = hit[b[near]] = True
            if hit.any():
                yield pa.RecordBatch.from_pydict({c: some[c].to_numpy()[hit] for c in ("key", "t", "id")})

    def dealt(live: DataFrame, *more: str) -> DataFrame:
        # few bytes and much work, so the number of tasks goes by rows
        return units(live, PART).repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "part").select("key", "i", "j", "part", "id", "t", *more)

    kept = cut(dealt(spread.join(full, "key"), "sign").mapInArrow(hopeful, "key long, t int, id long").distinct(), "hopeful")
    again = kept.groupBy("key").agg(F.count("*").alias("members"))
    heavy = reps.join(coded.drop("sign"), "id").join(kept.select("id").distinct(), "id", "left_semi")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, first, n, root): links first found in this table, and the smallest first tied to it within the unit."""
        for batch in groups(batches):
            for some in by_length(batch, batch.column_names.index("vec")):
                x, code = _unit(matrix(some["vec"])), matrix(some["codes"], np.int64)
                first, weight, table = (some[c].to_numpy() for c in ("first", "weight", "t"))
                n, found = np.zeros(len(some), np.int64), []
                for a, b in pairs(some, PAIRS, DENSE, lambda a, b: x[a] @ x[b].T >= threshold):
                    if a is None:
                        a, b = b
                    else:
                        link = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                        a, b = a[link], b[link]
                    for k in range(0, len(a), PAIRS):
                        p, q = a[k : k + PAIRS], b[k : k + PAIRS]
                        new = (code[p] == code[q]).argmax(1) == table[p]
                        n += np.bincount(p[new], weight[q[new]], len(n)).astype(np.int64) + np.bincount(q[new], weight[p[new]], len(n)).astype(np.int64)
                    found.append((a, b))
                if not found:
                    continue
                a, b = (np.concatenate([f[k] for f in found]) for k in range(2))
                root = first.copy()
                while True:  # the smallest first over links, to the end of each chain within a unit
                    old = root.copy()
                    np.minimum.at(root, a, old[b])
                    np.minimum.at(root, b, old[a])
                    if (old == root).all():
                        break
                out = (n > 0) | (root != first)
                if out.any():
                    yield pa.RecordBatch.from_pydict({"id": some["id"].to_numpy()[out], "first": first[out], "n": n[out], "root": root[out]})

    found = dealt(kept.join(again, "key").join(heavy, "id"), "vec", "codes", "first", "weight").mapInArrow(linked, "id long, first long, n long, root long")
    found = cut(found.groupBy("id", "first", "root").agg(F.sum("n").alias("n")), "found")
    edges = found.select(F.col("first").alias("a"), F.col("root").alias("b"))
    # an id with vectors of several classes ties them
    several = cut(good.groupBy("id").agg(F.count("*").alias("members"), F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi")).where("lo <> hi").select("id", "members"), "several")
    if not several.isEmpty():
        of_several = join_spread(good.select("id", *keys), several, ["id"], total).drop("members")
        edges = edges.unionByName(join_spread(of_several, classes.select(*keys, "first", "members"), keys, total).select(F.col("id").alias("a"), F.col("first").alias("b")))
    tied = components(edges).withColumnRenamed("node", "first")
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    known = classes.join(counts, "rep", "left").join(tied, "first", "left").select(*keys, "members", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n"), F.coalesce("component", "first").alias("component"))
    own = join_spread(good.select("id", *keys), cut(known, "known"), keys, total).select("id", "n", "component")
    rest = rows.where("vec is null or id is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    every = own.unionByName(rest)
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


#: For a threshold of 0.9.
ORACLE = """
with recursive v as (select vec_id, cast(embedding as double[]) e from embeddings),
good as (select vec_id, e, list_max(list_transform(e, lambda x: abs(x))) m from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
u as (select vec_id, list_transform(e, lambda x: x / m) e from good),
z as (select vec_id, e, sqrt(list_dot_product(e, e)) l from u),
ends as (select a.vec_id a, b.vec_id b from z a join z b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where case when len(a.e) = len(b.e) then list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9e0 else false end),
reach(a, b) as (select a, b from ends union select r.a, e.b from reach r join ends e on e.a = r.b),
least_ as (select a, min(b) m from reach group by a),
n as (select a, count(*) n from ends group by a)
select vec_id, coalesce(n.n, 0) n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id <= coalesce(m, vec_id) kept from v left join n on n.a = vec_id left join least_ t on t.a = vec_id
"""
