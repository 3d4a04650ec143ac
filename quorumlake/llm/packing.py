"""Packing of documents' tokens into sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered, vocabulary_path
from .shared import cut, release

CAPACITY = 4096
END = 2
#: Pieces in a group, about; each group is packed by itself and leaves one badly filled sequence or two.
GROUP = 4096

_known: dict[str, Remembered] = {}


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Documents cut into pieces of capacity tokens and a rest: (doc_id, start, length, ids_crc32, doc_tokens[, ids array<int>]).

    A document is its whole text's ids and then end, so one without text is a piece of one token.
    """
    path = path or vocabulary_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known.setdefault(path, Remembered(path))
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for ids, n in known.ids(batch.column(1)):
                ends = np.cumsum(n)
                ids = np.insert(ids.astype("<u4"), ends, end)
                out: list[tuple] = []
                for d, a, b in zip(doc_ids[at : at + len(n)], ends - n + np.arange(len(n)), ends + np.arange(1, len(n) + 1), strict=True):
                    for s in range(a, b, capacity):
                        own = ids[s : min(s + capacity, b)]
                        out.append((d, s - a, len(own), zlib.crc32(own), b - a, *[own.view("<i4")] * keep_ids))
                at += len(n)
                columns = [*zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if k == "ids" else pa.int64()) for c, k in zip(columns, names, strict=True)], names)
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of items given in decreasing order.

    The tree's leaves are the bins' free room and each node has the larger of its children, so the
    first bin with room enough is found in as many steps as the tree has levels.
    """
    n = max(1, len(lengths))
    leaves = 1 << (n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
    return bins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: the columns of pieces() and sequence_id long, offset long.

    Each token lies in exactly one piece; a sequence holds at most capacity tokens, without gaps from 0.
    Pieces are dealt into groups of about GROUP by a hash of id, start, content and place in the table of pieces,
    and each group is packed by itself; a row repeated any number of times is spread over all groups.
    Null and repeated ids and rows are packed like others; no documents give no rows. Other columns are ignored.
    """
    own = cut(pieces(docs, id_col, text_col, path, capacity, end, keep_ids), "pieces")
    groups = max(1, -(-own.count() // GROUP))
    # where the row stands in the stored table tells even equal rows apart, so no repeated row fills a group
    stands = [F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1), F.col("_metadata.row_index")]
    dealt = own.select(F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", *stands), F.lit(groups)).cast("int").alias("g"), "*")
    schema = own.schema.add("sequence_id", "long").add("offset", "long")

    def run(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        ids = table["doc_id"].fill_null(-1).to_numpy()
        order = np.lexsort((table["ids_crc32"].to_numpy(), table["start"].to_numpy(), ids, -length))
        bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        bins[order], offsets[order] = first_fit_decreasing(length[order], capacity)
        out = table.drop_columns(["g"])
        return out.append_column("sequence_id", pa.array((table["g"][0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("g").applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>, doc_ids array<long>) of pack(..., keep_ids=True): what a trainer reads. A group has one sequence's tokens."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
