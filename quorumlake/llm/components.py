"""Connected components of a distributed edge list, by alternating large-star and small-star; joins whose keys may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Each round at least halves the longest path; no table has more than 2**64 nodes.
MOST_ROUNDS = 200
#: A key with more than one in SHARE of all rows is frequent; there are fewer than SHARE such keys, whatever the rows.
SHARE = 200


def join_spread(rows: DataFrame, one: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with one, which has a row for each key and the number of its rows, members.

    total: number of rows. The rows of frequent keys meet theirs by a broadcast of fewer than SHARE keys, so
    they never come together in a task; all others are joined as Spark sees fit. Keys are not null.
    """
    often = F.col("members") > max(64, total // SHARE)
    more = [c for c in one.columns if c not in keys]
    few = one.where(often).select(*keys, F.struct(*more).alias("__ql_few"))
    marked = rows.join(F.broadcast(few), keys, "left")
    own = [c for c in rows.columns if c not in keys]
    frequent = marked.where("__ql_few is not null").select(*keys, *own, *[F.col(f"__ql_few.{c}").alias(c) for c in more])
    rest = marked.where("__ql_few is null").drop("__ql_few").join(one.where(~often), keys)
    return frequent.unionByName(rest.select(frequent.columns))


def _large(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("members")).select("a", F.least("a", "m").alias("m"), "members")
    return join_spread(both.where("b > a"), least.where("members > 0"), ["a"], n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame, n: int) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("members"))
    moved = join_spread(e, least, ["a"], n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of any order, loops and repeats allowed. Returns (node, component): the smallest node reachable.

    Only nodes that have an edge to another one are returned; null ends are dropped.
    The rows of a round are as many as the edges at most; a very connected node is only ever
    in a map-side aggregate or a broadcast, never in one group. Rounds that don't end are an error.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges")

    def state(x: DataFrame) -> tuple:  # one small job
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(e)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        e = cut(_small(cut(_large(e, before[0]), "edges"), before[0]), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
