"""Buckets, of whatever size, as units of work of bounded size: pairs of parts of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What tells units apart.
UNIT = ("key", "i", "j")


def units(live: DataFrame, size: int) -> DataFrame:
    """(key, i, j, part, ...): each row goes to every unit (i, j), i <= j, of its bucket that its part belongs to.

    live: (key, members: rows of the key, id, ...). The bucket's rows are dealt into parts of about size by a hash of id.
    """
    parts = F.ceil(F.col("members") / size).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    units = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(F.least(p, mine).alias("i"), F.greatest(p, mine).alias("j")))
    return live.select("key", mine.alias("part"), F.explode(units).alias("u"), *[c for c in live.columns if c not in ("key", "members")]).select("key", "u.i", "u.j", "part", *[c for c in live.columns if c not in ("key", "members")])


def _starts(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where units begin in a table that is sorted by them."""
    new = np.ones(len(table), bool)
    new[1:] = False
    for c in UNIT:
        own = table[c].to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.flatnonzero(new)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole units of a partition that is sorted by them, many at once."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        starts = _starts(batch)
        goes_on = bool(rest) and all(rest[-1][c][len(rest[-1]) - 1].as_py() == batch[c][0].as_py() for c in UNIT)
        last = int(starts[-1])
        if goes_on and last == 0:
            rest.append(batch)
            continue
        done = [*rest, batch.slice(0, last)]
        if any(map(len, done)):
            yield pa.Table.from_batches(done).combine_chunks()
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def pairs(table: pa.Table, most: int, dense: int | None = None, linked: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple]:
    """(a, b): rows of pairs within units, each pair once, about most of them at once.

    A unit (i, i) has all its pairs, one (i, j) those between its parts. Of a unit with more than dense
    rows, (None, (a, b)) has those pairs that linked(rows, rows), a matrix, marks.
    """
    if not len(table):
        return
    starts = _starts(table)
    sizes = np.diff(np.append(starts, len(table)))
    i, j, part = (table[c].to_numpy() for c in ("i", "j", "part"))
    at = np.arange(len(table))
    end = np.repeat(starts + sizes, sizes)
    other = (part != i).astype(np.int64)
    head = np.concatenate([[0], np.cumsum(1 - other)])
    middle = np.repeat(starts, sizes) + np.repeat(head[starts + sizes] - head[starts], sizes)  # rows are sorted by part
    low = np.where(i == j, at + 1, np.where(part == i, middle, end))
    count = end - low
    if dense is not None and linked is not None:
        for s in np.flatnonzero(sizes > dense):
            rows = slice(int(starts[s]), int(starts[s] + sizes[s]))
            own = at[rows]
            if i[rows.start] == j[rows.start]:
                a = b = own
            else:
                a, b = own[: int(middle[rows.start]) - rows.start], own[int(middle[rows.start]) - rows.start :]
            p, q = np.nonzero(linked(a, b)) if len(a) and len(b) else (at[:0], at[:0])
            p, q = a[p], b[q]
            once = p < q
            yield None, (p[once], q[once])
            count[rows] = 0
    total = np.cumsum(count)
    begin = 0
    while begin < len(at):
        before = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
        n = count[begin:stop]
        if n.any():
            a = np.repeat(at[begin:stop], n)
            yield a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[begin:stop], n)
        begin = stop
