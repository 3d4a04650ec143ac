"""Byte-pair encoding by a table of distinct words, and decoding by a join with a table of pieces.

Texts are split where the tokenizers used here always split: at blanks and, within words of ASCII
letters, digits and signs, between these. So a text's ids are its words' ids one after the other.
Documents are dealt into blocks of about BLOCK bytes; each block sends its distinct words, packed,
to the word table, where each distinct word of the corpus is encoded once; the ids come back to
the block by a join and are put in place by position.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release
from .words import LONGEST, hash_segments, segment_sums, text_bytes

#: Bytes of text in a block, about, and blocks for each bucket of the word table: both follow from the data, never from the session.
BLOCK, BLOCKS_A_BUCKET = 8 << 20, 4
#: Words whose ids a worker remembers (it starts anew beyond that), and words encoded at once.
REMEMBERED, AT_ONCE = 2_000_000, 20_000
#: Bytes of text split at once, and ids decoded at once.
CHUNK, DECODED = 4 << 20, 1 << 16

#: Blanks 0, letters 1, digits 2, signs 3; 4: a word with such a byte is left whole.
_KIND = np.full(256, 4, np.uint8)
_KIND[:128] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[[0x27, 0x3C]] = 4  # ' may begin a contraction, < the string of a special token
#: First bytes of two-byte characters that are letters, lower-cased into one letter and unchanged by composition (but for the two signs of C3).
_LETTERS = (0xC3, 0xC5, 0xD0, 0xD1)
_SIGNS = (0x97, 0xB7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _split(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    kind = _KIND[data]
    for byte in _LETTERS:
        lead = np.flatnonzero(data == byte)
        if len(lead):
            lead = lead[~np.isin(data[lead + 1], _SIGNS)] if byte == 0xC3 else lead
            kind[lead] = kind[lead + 1] = 1
    full = kind != 0
    new = np.ones(len(data), bool)
    new[1:] = ~full[:-1]
    inner = bounds[1:-1]
    new[inner[inner < len(data)]] = True
    new &= full
    cut = new.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut &= full
    at = np.flatnonzero(cut)
    if not len(at):
        return pa.array([], pa.string()), np.zeros(len(bounds) - 1, np.int64)
    heads = new[at]
    word = np.cumsum(heads) - 1
    whole = np.zeros(word[-1] + 1, bool)
    whole[word[kind[at] == 4]] = True
    stay = heads | ~whole[word]
    at, whole = at[stay], whole[word[stay]]
    place = np.cumsum(full) - full
    size = int(place[-1]) + int(full[-1])
    ends = np.append(place[at], size)
    own = data[full]
    low = _LOWER[own]
    if whole.any():
        as_is = np.repeat(whole, np.diff(ends))
        low[as_is] = own[as_is]
    pieces = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(low.tobytes())])
    return pieces, np.diff(np.searchsorted(at, bounds))


def split_words(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words in order, words of each text) for some texts after the other (null: empty).

    Words of plain letters, digits and signs are lower-cased in ASCII and split into runs of letters, single digits and runs of signs; any other is left as it stands.
    """
    data, bounds = text_bytes(texts)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        yield _split(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


@lru_cache(maxsize=2)
def _last(path: str) -> np.ndarray:
    """For each id whether it ends a word."""
    return np.array([bool(p) and p.endswith("</w>") for p in pieces(path)])


def _simple(word: str) -> bool:
    return word.isalpha() or (word.isascii() and "'" not in word and "<" not in word)


def _encoded(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, ids of each). Words that make one token run each are encoded as one text and told apart by the ids that end a word."""
    own, last = tokenizer(path), _last(path)
    plain = np.fromiter(map(_simple, words), bool, len(words))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (words' numbers, ids, sizes)
    for some in (True, False):
        at = np.flatnonzero(plain == some)
        for i in range(0, len(at), AT_ONCE):
            part = [words[k] for k in at[i : i + AT_ONCE].tolist()]
            if some:
                ids = np.array(own.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(last[ids]) + 1
                if len(ends) == len(part) and ends[-1] == len(ids):
                    parts.append((at[i : i + AT_ONCE], ids, np.diff(ends, prepend=0)))
                    continue
            found = [e.ids for e in own.encode_batch_fast(part, add_special_tokens=False)]
            parts.append((at[i : i + AT_ONCE], np.array([x for f in found for x in f], np.uint32), np.array([len(f) for f in found], np.int64)))
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at, ids, sizes = (np.concatenate([p[k] for p in parts]) for k in range(3))
    back = np.empty(len(words), np.int64)
    back[at] = np.arange(len(words))
    return _gathered(ids, np.cumsum(sizes) - sizes, sizes, back)


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what stands at these places one after the other, how much of it each place has)."""
    n = sizes[at]
    return flat[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def _of_texts(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of n over texts of so many words each."""
    total = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class _Table:
    """Words' places by two sums of 56 bits, in the order of the first."""

    def __init__(self) -> None:
        self.one, self.two, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places; -1 for unknown words."""
        if not len(self.one):
            return np.full(len(one), -1, np.int64)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), self.place[at], -1).astype(np.int64)

    def add(self, one: np.ndarray, two: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(one)
        at = np.searchsorted(self.one, one[order])
        self.one, self.two, self.place = (np.insert(a, at, x[order]) for a, x in ((self.one, one), (self.two, two), (self.place, place)))


class Remembered:
    """Ids of the words that a worker has met, REMEMBERED at most and about 50 bytes each."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.most, self.new = _Table(), _Table()
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of some distinct words stands; those unknown are encoded first."""
        data, bounds = text_bytes(words)
        starts, lengths = bounds[:-1] - bounds[0], np.diff(bounds)
        one, two = segment_sums(data[bounds[0] : bounds[-1]].astype(np.uint64) + np.uint64(1), starts)
        short = lengths <= LONGEST
        at = self.most.find(one, two)
        left = np.flatnonzero(at < 0)
        at[left] = self.new.find(one[left], two[left])
        fresh = np.flatnonzero((at < 0) | ~short)
        if len(fresh):
            ids, sizes = _encoded(words.take(pa.array(fresh)).to_pylist(), self.path)
            at[fresh] = np.arange(len(self.sizes), len(self.sizes) + len(fresh))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
            kept = fresh[short[fresh]]
            self.new.add(one[kept], two[kept], at[kept].astype(np.int32))
            if len(self.new.one) > len(self.most.one) // 8:
                self.most.add(self.new.one, self.new.two, self.new.place)
                self.new = _Table()
        return at

    def ids(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some whole texts one after the other, ids of each), for some texts after the other."""
        for words, counts in split_words(texts):
            if len(self.sizes) > REMEMBERED:
                self.clear()
            if not len(words):
                yield np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
                continue
            listed = words.dictionary_encode()
            at = self.places(listed.dictionary)
            ids, n = _gathered(self.flat, self.starts, self.sizes, at[listed.indices.to_numpy()])
            yield ids, _of_texts(n, counts)


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _swell(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _packed(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, sizes, blob): the texts of some documents of a block, compressed.

    A repeated row goes to another block for each partition that holds it, so no block has more of them than a partition.
    """
    to = F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    rows = docs.select(to.alias("block"), "id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
                texts = [t.encode() for t in batch.column(2).take(pa.array(own)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block[own[0]]], pa.int32()), pa.array([batch.column(1).take(pa.array(own)).to_pylist()], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([_squeeze(b"".join(texts))], pa.binary())],
                    ["block", "ids", "sizes", "blob"],
                )

    return rows.mapInArrow(run, "block int, ids array<long>, sizes array<long>, blob binary")


def _texts(table: pa.Table) -> Iterator[tuple[list[int | None], pa.Array]]:
    """(ids, texts) of each row."""
    for ids, sizes, blob in zip(table["ids"], table["sizes"], table["blob"], strict=True):
        bounds = np.concatenate([[0], np.cumsum(np.array(sizes.as_py(), np.int64))])
        yield ids.as_py(), pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(_swell(blob.as_py()))])


def _dealt(lists: list[pa.Array], buckets: int) -> tuple[pa.Array, np.ndarray]:
    """(the distinct words of lists by bucket, then alphabetically; where each bucket begins): the same for any order of the lists."""
    known = pa.chunked_array(lists, pa.string()).unique()
    known = known.take(pc.sort_indices(known))
    if not len(known):
        return known, np.zeros(buckets + 1, np.int64)
    data, bounds = text_bytes(known)
    starts, data = bounds[:-1] - bounds[0], data[bounds[0] : bounds[-1]]
    # words beyond LONGEST share the last multiplier: that only deals them less evenly
    to = hash_segments(data.astype(np.uint64) + np.uint64(1), starts) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    return known.take(pa.array(order)), np.searchsorted(to[order], np.arange(buckets + 1))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """(id_col long, ids_col array<int>): a row per row of docs, its whole text's ids without special tokens added.

    Null and empty texts have no ids. Strings of special tokens in a text become these tokens, as
    with the library. Repeated rows and ids, and null ids, stay as they are; other columns are left out.
    """
    path = path or vocabulary_path()
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(parts, -(-size // BLOCK))
    buckets = max(1, blocks // BLOCKS_A_BUCKET)
    packed = _packed(own, blocks).repartition(blocks, "block")

    def listed(table: pa.Table) -> pa.Table:
        lists = [words.unique() for _, texts in _texts(table) for words, _ in split_words(texts)]
        words, bounds = _dealt(lists, buckets)
        del lists
        full = np.flatnonzero(np.diff(bounds)).tolist()
        blobs = [_squeeze("\n".join(words.slice(bounds[i], bounds[i + 1] - bounds[i]).to_pylist()).encode()) for i in full]
        release()
        return pa.table({"block": pa.array([table["block"][0].as_py()] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "words": pa.array(blobs, pa.binary())})

    def encoded(table: pa.Table) -> pa.Table:
        lists = [pa.array(_swell(w.as_py()).decode().split("\n"), pa.string()) for w in table["words"]]
        known = pa.chunked_array(lists, pa.string()).dictionary_encode().combine_chunks()
        known = known.chunk(0) if isinstance(known, pa.ChunkedArray) else known
        flat, sizes = _encoded(known.dictionary.to_pylist(), path)
        kind = "<u4" if tokenizer(path).get_vocab_size() > 65536 else "<u2"
        starts, at = np.cumsum(sizes) - sizes, known.indices.to_numpy()
        blobs, begin = [], 0
        for words in lists:
            ids, n = _gathered(flat, starts, sizes, at[begin : begin + len(words)])
            begin += len(words)
            blobs.append((_squeeze(n.astype("<u4").tobytes()), _squeeze(ids.astype(kind).tobytes())))
        del lists, known, flat, at
        release()
        return pa.table({"block": table["block"], "bucket": table["bucket"], "sizes": pa.array([b[0] for b in blobs], pa.binary()), "ids": pa.array([b[1] for b in blobs], pa.binary()), "kind": pa.array([kind] * len(blobs))})

    table = packed.groupBy("block").applyInArrow(listed, "block int, bucket int, words binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(encoded, "block int, bucket int, sizes binary, ids binary, kind string")

    def placed(texts: pa.Table, found: pa.Table) -> pa.Table:
        groups = []
        for doc_ids, own in _texts(texts):
            groups.append((doc_ids, [(words.dictionary_encode(), counts) for words, counts in split_words(own)]))
        lists = [d.dictionary for _, g in groups for d, _ in g]
        words, _ = _dealt(lists, buckets)
        # each distinct word of each part is looked up once, all of them together
        places = pc.index_in(pa.chunked_array(lists, pa.string()), value_set=words).to_numpy().astype(np.int64)
        begins = iter(np.cumsum([0, *map(len, lists)]).tolist())
        found = found.sort_by("bucket")
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(_swell(x.as_py()), "<u4").astype(np.int64) for x in found["sizes"])])
        flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(_swell(x.as_py()), k.as_py()).astype(np.int32) for x, k in zip(found["ids"], found["kind"], strict=True))])
        starts, out = np.cumsum(sizes) - sizes, []
        for doc_ids, parts in groups:
            begin = 0
            for d, counts in parts:
                ids, n = _gathered(flat, starts, sizes, places[next(begins) + d.indices.to_numpy().astype(np.int64)])
                bounds = np.concatenate([[0], np.cumsum(_of_texts(n, counts))])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                out.append(pa.record_batch([pa.array(doc_ids[begin : begin + len(counts)], pa.int64()), lists], ["id", "ids"]))
                begin += len(counts)
        del groups, lists, words, places, flat, sizes
        release()
        return pa.Table.from_batches(out, pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    out = packed.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(placed, "id long, ids array<int>")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col))


def pieces(path: str | None = None) -> list[str | None]:
    """The piece of each id; as many as the vocabulary has entries."""
    own = tokenizer(path or vocabulary_path())
    return [own.id_to_token(i) for i in range(own.get_vocab_size())]


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """encoded with text_col in place of ids_col: the pieces of the ids, special tokens kept, joined by blanks as a tokenizer without a decoder joins them.

    Some rows at once, about DECODED ids, send their distinct ids to a join with the table of pieces, which has one row
    for each entry of the vocabulary and so may be broadcast. The first of these ids brings the rows along; a
    join by broadcast leaves them together (ids that came apart are an error). No ids give an empty text, null ids a
    null one; an id outside the vocabulary is left out. Rows and other columns stay.
    """
    spark = encoded.sparkSession
    names = [c for c in encoded.columns if c not in (ids_col, text_col)]
    own = encoded.select(*[F.col(f"`{c}`") for c in names], F.col(ids_col).cast("array<int>").alias(ids_col))
    table = spark.createDataFrame([(i, p) for i, p in enumerate(pieces(path)) if p is not None], "id int, piece string")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            ends = np.cumsum(pc.list_value_length(batch.column(len(names))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < len(batch):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODED, "right")))
                part = batch.slice(at, stop - at)
                at = stop
                ids = part.column(len(names)).flatten().drop_null().unique()
                ids = ids.take(pc.sort_indices(ids)) if len(ids) else pa.array([None], pa.int32())
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                blob = pa.array([sink.getvalue().to_pybytes(), *[None] * (len(ids) - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(ids)), pa.int32()), pa.array(np.full(len(ids), len(ids)), pa.int32()), blob], ["id", "pos", "of", "rows"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < len(batch):
                due = int((held[0]["of"] if held else batch["of"])[0 if held else at].as_py()) - sum(map(len, held))
                held.append(batch.slice(at, due))
                at += due
                if sum(map(len, held)) == held[0]["of"][0].as_py():
                    yield written(pa.Table.from_batches(held).combine_chunks())
                    held = []
        if held:
            raise RuntimeError("ids of some rows are missing")

    def written(found: pa.Table) -> pa.RecordBatch:
        if (found["pos"].to_numpy() != np.arange(len(found))).any():
            raise RuntimeError("ids of some rows came apart")
        rows = pa.ipc.open_stream(found["rows"][0].as_buffer()).read_next_batch()
        ids = rows.column(len(names))
        flat = ids.flatten()
        at = pc.index_in(flat, value_set=found["id"].combine_chunks().drop_null()) if len(flat) else pa.array([], pa.int32())
        taken = found["piece"].combine_chunks().take(at)
        there = np.asarray(pc.is_valid(taken))
        sizes = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(sizes)])]
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), taken.drop_null()), " ")
        text = pc.if_else(pc.is_valid(ids), text, pa.scalar(None, text.type)).cast(pa.string())
        return pa.RecordBatch.from_arrays([*rows.columns[: len(names)], text], [*names, text_col])

    kinds = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in own.select(*[F.col(f"`{c}`") for c in names]).schema)
    distinct = own.mapInArrow(listed, "id int, pos int, of int, rows binary")
    return distinct.join(F.broadcast(table), "id", "left").select("id", "pos", "of", "rows", "piece").mapInArrow(joined, f"{kinds}`{text_col}` string")
