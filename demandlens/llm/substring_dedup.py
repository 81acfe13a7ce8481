"""Repeated passages of words: a de Bruijn graph of word k-mers whose repeated paths are cut out.

Each run of ``k`` words is an edge between its first and its last k - 1 words. Two joins on edges put
the graph together:

1. Every chunk of documents sends 32 bits of its edges' hashes, packed, to the bucket of their range,
   and learns which of them another chunk may have too. Edges seen once leave here, but for a few.
2. The edges left are sent with a second hash and their coordinates (document, position). A bucket
   answers with the coordinates of the edge's source, its first occurrence in the smallest document.

In a document consecutive edges share a node, so a path is compacted where its coordinates run along
those of one source step by step; a branch of the graph shows as a step that the source does not make,
and ends the path. An edge counts as repeated only when both hashes (64 bits and the bucket's range of
the other 64) agree and its source lies in a document with a smaller id. Words of such edges are removed.

A chunk sends each edge once however often it holds it, so one passage in a third of all documents costs
a bucket one entry a chunk. Chunks and buckets are bounded by the number of bytes; the texts are
shuffled once, and all passes read that shuffle.

Defined cases: a null text has no words; documents with fewer than ``k`` words stay whole. A row without
an id counts as larger than all ids; rows that share an id are never each other's source. A document
longer than a chunk is read whole, as a chunk of its own size. Empty tables give empty results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from demandlens.llm.common import WordHash, chunked, distinct, mix, pack, parts, text_bytes, unpack, windows

K = 13
#: Bytes of text in a chunk and, on average, of the texts whose edges fall in a bucket.
CHUNK_BYTES, BUCKET_BYTES = 6_000_000, 12_000_000
#: Stands for a missing id.
LAST = np.iinfo(np.int64).max

EDGES = "bucket int, chunk int, hashes binary"
SHARED = "chunk int, bucket int, shared binary"
_PLACED = "bucket int, chunk int, hashes binary, docs binary, places binary"
_SOURCES = "chunk int, hashes binary, docs binary, places binary"
_RESULT = (
    "doc_id long, n_words long, n_removed long, kept binary, "
    "spans array<struct<start: long, length: long, source_id: long, source_start: long>>"
)


def table_of(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], names=list(schema))


INT, BIN, LONG = pa.int32(), pa.binary(), pa.int64()


@functools.lru_cache(1)
def _hashes() -> WordHash:
    """One for each worker process, which all its chunks share."""
    return WordHash()


class Chunk:
    """The words of a chunk's documents in the order of ids, and the edges of them all in one array."""

    def __init__(self, table: pa.Table, k: int):
        keys = table.column("doc_id").cast(LONG)
        ids = keys.fill_null(LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        column = table.column("text")
        self.ids, self.null = ids[order], keys.is_null().to_numpy()[order]
        self.words = [column[int(i)].as_py().split() for i in order]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.sizes = np.maximum(counts - k + 1, 0)
        self.row = np.repeat(np.arange(len(counts)), self.sizes)
        self.place = np.arange(int(self.sizes.sum())) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        # All documents in one array; windows that reach into the next document are left out.
        self._values = np.concatenate([*map(_hashes().of, self.words), np.zeros(0, np.uint64)])
        self._at, self._k = (np.cumsum(counts) - counts)[self.row] + self.place, k

    @functools.cached_property
    def first(self) -> np.ndarray:
        return windows(self._values, self._k)[self._at]

    @functools.cached_property
    def second(self) -> np.ndarray:
        return windows(mix(self._values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self._k)[self._at]


def ranges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; buckets are ranges of equal width."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_buckets: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    at = np.searchsorted(sorted_buckets, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), slice(int(at[b]), int(at[b + 1]))


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours start."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def shared(table: pa.Table) -> pa.Table:
    """For each chunk's sorted hashes in a bucket, one bit each: whether another chunk has it."""
    bucket = table.column("bucket")[0].as_py()
    sent = [unpack(x.as_py(), np.uint32) for x in table.column("hashes")]
    hashes = np.concatenate(sent)
    order = np.argsort(hashes)
    equal = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:]] = equal
    twice[order[:-1]] |= equal
    ends = np.cumsum([len(x) for x in sent])
    rows = [
        (c.as_py(), bucket, np.packbits(twice[e - len(x) : e]).tobytes())
        for c, x, e in zip(table.column("chunk"), sent, ends)
    ]
    return table_of({"chunk": INT, "bucket": INT, "shared": BIN}, rows)


def cut_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept`` (the words left, one space between) and ``spans``."""
    size = text_bytes(docs)
    buckets = parts(size, BUCKET_BYTES)
    chunks = chunked(docs, parts(size, CHUNK_BYTES), by_text=True)

    def edges(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        found = distinct(Chunk(table, k).first)
        # The range is the hash's upper part; the lower one tells edges of a range apart well enough here.
        rows = [(b, number, pack(found[s].astype(np.uint32))) for b, s in cuts(ranges(found, buckets), buckets)]
        return table_of({"bucket": INT, "chunk": INT, "hashes": BIN}, rows)

    def placed(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = {"bucket": INT, "chunk": INT, "hashes": BIN, "docs": BIN, "places": BIN}
        if not table.num_rows or not answers.num_rows:
            return table_of(schema, [])
        number, chunk = table.column("chunk")[0].as_py(), Chunk(table, k)
        order = np.argsort(chunk.first)
        starts = starts_of(chunk.first[order])
        found = chunk.first[order[starts]]
        twice = np.zeros(len(found), bool)
        masks = dict(zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist()))
        for b, s in cuts(ranges(found, buckets), buckets):
            twice[s] = np.unpackbits(np.frombuffer(masks[b], np.uint8), count=s.stop - s.start)
        again = np.empty(len(order), bool)
        again[order] = np.repeat(twice, np.diff(np.append(starts, len(order))))
        some = np.flatnonzero(again)
        bucket, second = ranges(chunk.first[some], buckets), chunk.second[some]
        # The first of equal edges stays; rows are in the order of ids, edges in that of places.
        order = np.lexsort((second, bucket))
        first = order[starts_of(second[order])]
        bucket = bucket[first]
        first = some[first]
        rows = [
            (b, number, pack(chunk.second[first[s]]), pack(chunk.ids[chunk.row[first[s]]]), pack(chunk.place[first[s]]))
            for b, s in cuts(bucket, buckets)
        ]
        return table_of(schema, rows)

    def sources(table: pa.Table) -> pa.Table:
        sent = [unpack(x.as_py()) for x in table.column("hashes")]
        hashes = np.concatenate(sent)
        ids = np.concatenate([unpack(x.as_py(), np.int64) for x in table.column("docs")])
        places = np.concatenate([unpack(x.as_py(), np.int64) for x in table.column("places")])
        order = np.lexsort((ids, hashes))
        starts = starts_of(hashes[order])
        source = np.empty(len(order), np.int64)
        source[order] = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
        smaller = ids[source] < ids
        rows, end = [], 0
        for c, x in zip(table.column("chunk"), sent):
            some = end + np.flatnonzero(smaller[end : end + len(x)])
            end += len(x)
            if len(some):
                rows.append((c.as_py(), pack(hashes[some]), pack(ids[source[some]]), pack(places[source[some]])))
        return table_of({"chunk": INT, "hashes": BIN, "docs": BIN, "places": BIN}, rows)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, k)
        order = np.argsort(chunk.second, kind="stable")
        keys = chunk.second[order]
        starts = starts_of(keys)
        source, place = chunk.ids[chunk.row[order[starts]]], chunk.place[order[starts]]
        if answers.num_rows:
            asked = np.concatenate([unpack(x.as_py()) for x in answers.column("hashes")])
            at = np.searchsorted(keys[starts], asked)
            source[at] = np.concatenate([unpack(x.as_py(), np.int64) for x in answers.column("docs")])
            place[at] = np.concatenate([unpack(x.as_py(), np.int64) for x in answers.column("places")])
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        source, place = source[group], place[group]
        repeated = source < chunk.ids[chunk.row]
        rows, end = [], 0
        for i, words in enumerate(chunk.words):
            here = slice(end, end + int(chunk.sizes[i]))
            end = here.stop
            spans, kept = _compact(repeated[here], source[here], place[here], len(words), k)
            left = words if kept is None else [w for w, keep in zip(words, kept) if keep]
            key = None if chunk.null[i] else int(chunk.ids[i])
            rows.append((key, len(words), len(words) - len(left), b" ".join(left), spans))
        span = pa.list_(pa.struct([(n, LONG) for n in ("start", "length", "source_id", "source_start")]))
        return table_of({"doc_id": LONG, "n_words": LONG, "n_removed": LONG, "kept": BIN, "spans": span}, rows)

    known = chunks.groupBy("chunk").applyInArrow(edges, EDGES).groupBy("bucket").applyInArrow(shared, SHARED)
    paired = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(placed, _PLACED)
    origin = paired.groupBy("bucket").applyInArrow(sources, _SOURCES)
    return chunks.groupBy("chunk").cogroup(origin.groupBy("chunk")).applyInArrow(cut, _RESULT)


def _compact(repeated: np.ndarray, source: np.ndarray, place: np.ndarray, n_words: int, k: int) -> tuple[list[dict], np.ndarray | None]:
    """Paths along one source, as spans of words, and which words stay (None: all)."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return [], None
    source, place = source[at], place[at]
    step = (np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(place) != 1)
    first = np.append(0, np.flatnonzero(step) + 1)
    last = np.append(first[1:], len(at)) - 1
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, at[first], 1)
    np.add.at(change, at[last] + k, -1)
    spans = [
        {"start": int(at[a]), "length": int(at[z] - at[a] + k), "source_id": int(source[a]), "source_start": int(place[a])}
        for a, z in zip(first, last)
    ]
    return spans, np.cumsum(change)[:n_words] == 0
