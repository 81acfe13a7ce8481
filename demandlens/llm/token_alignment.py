"""Which tokens of one tokenizer cover the same bytes as which tokens of another.

Tokenizer A is a byte-level vocabulary, B a piece vocabulary that puts a space before the text. Both read the
whole text. The steps for a document:

1. A token's bytes give its length, so running sums give where each token of A and of B ends.
2. Anchors are the byte offsets at which a token of A and a token of B both begin with a space mark; that both
   begin there is checked on the offsets, not taken from the texts' white space.
3. Anchors cut the document into windows, a pair of id tuples each. A window's alignment (its groups and the id
   pairs whose bytes overlap) depends on these ids alone, so it is found once and kept by them.

A slice of documents (bounded in bytes) sends each of its id pairs once, with its number of links; the sums over
the corpus come back to the slice as one row for each pair. So neither links nor documents are shuffled by id,
and a pair that every document holds costs one row a slice.

Defined cases: a text that is null, empty or whose joined token bytes differ from space+text has no tokens, and
zeros. Tokens that end within a character are handled by bytes. Special tokens' strings inside texts are plain
text. Repeated rows are aligned and counted each; an empty table gives an empty result. A document is never cut,
so one that is longer than ``SLICE_BYTES`` is a slice of its own. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import pack, texts, unpack
from demandlens.session import stage

#: Bytes of text that are counted and looked up together.
SLICE_BYTES = 4_000_000
#: Links that a worker keeps in its windows.
KEPT = 1_500_000

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, slice long, "
    "used binary, times binary, sizes binary, places binary, pairs array<long>, links array<long>"
)
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"


class ByteVocabulary:
    """Ids and bytes of a byte-level vocabulary file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {x["content"] for x in described["added_tokens"]}
        # Printable bytes stand for themselves, the others for code points from 256 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = sorted(set(range(256)) - set(own))
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
        ids = {bytes(map(byte_of.__getitem__, t)): i for t, i in described["model"]["vocab"].items() if t not in special}
        # An id is its merge's rank, so the ids are the ranks that the encoder needs.
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = token

    def encode(self, documents: list[str]) -> list[np.ndarray]:
        return [np.array(self.encoding.encode_ordinary(text), np.uint32) for text in documents]


class PieceVocabulary:
    """Ids and bytes of a piece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.model.get_piece_size())
        ]

    def encode(self, documents: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(documents, num_threads=1)]


class TokenBytes:
    """Sizes and bytes of a vocabulary's tokens."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.marked = np.array([t[:1] == b" " for t in tokens])
        self.short = self.size.astype(np.int32)
        self.start = np.cumsum(self.short, dtype=np.int32) - self.short
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.size[ids])

    def spell(self, ids: np.ndarray, full: np.ndarray) -> bool:
        """Whether the tokens' bytes, joined, are ``full``; compared in parts."""
        at = 0
        for first in range(0, len(ids), 100_000):
            some = ids[first : first + 100_000]
            size = self.short[some]
            ends = np.cumsum(size, dtype=np.int32)
            total = int(ends[-1])
            found = self.pool[np.repeat(self.start[some] - ends + size, size) + np.arange(total, dtype=np.int32)]
            if not np.array_equal(found, full[at : at + total]):
                return False
            at += total
        return at == len(full)


#: Stands between the ids of A and of B in a window's key.
MARK = 0xFFFFFFFF


class Windows(dict):
    """Numbers of windows by their ids, and each one's alignment, found with ``learn`` for all new ones together."""

    def __init__(self, of_a: TokenBytes, of_b: TokenBytes):
        super().__init__()
        self.of_a, self.of_b = of_a, of_b
        self.names = np.array(list(map(str, range(max(len(of_a.size), len(of_b.size))))), object)
        self.new: list[bytes] = []
        self.groups: list[str] = []
        self.codes, self.n_links = array("q"), array("q")

    def __missing__(self, key: bytes) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number

    def learn(self, together: int = 20_000) -> None:
        for at in range(0, len(self.new), together):
            self._align(self.new[at : at + together])
        self.new = []

    def _align(self, keys: list[bytes]) -> None:
        """The groups of each window as text, and a code for each pair of its tokens that overlap.

        The windows stand behind each other: both tokenizers' tokens of each end at the same byte.
        """
        ids = np.frombuffer(b"".join(keys), "<u4").astype(np.int64)
        marks = np.flatnonzero(ids == MARK)
        last = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)) // 4)
        side = np.zeros(len(ids), np.int8)
        side[marks] = 1
        side[last[:-1]] = -1
        is_b = np.cumsum(side, dtype=np.int8).astype(bool)
        a, b = ids[~is_b], ids[is_b & (ids != MARK)]
        end_a, end_b = self.of_a.ends(a), self.of_b.ends(b)
        # Of two tokens that overlap one ends first, or both end: a pair for each end.
        ends = np.sort(np.concatenate([end_a, end_b]))
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
        self.codes.frombytes((a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]).tobytes())
        # A window's last token of B, counted over all windows.
        final = np.cumsum(np.diff(last, prepend=0) - 1 - (marks - np.append(0, last[:-1]))) - 1
        self.n_links.frombytes(np.diff(np.searchsorted(ends, end_b[final]), prepend=-1).tobytes())
        # Groups end where tokens of both do. Names in order: a group's of A, then its of B.
        close_a, close_b = end_b[np.searchsorted(end_b, end_a)] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
        group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
        through_a, through_b = np.cumsum(np.bincount(group_a)), np.append(0, np.cumsum(np.bincount(group_b)))
        place_a, place_b = np.arange(len(a)) + through_b[group_a], np.arange(len(b)) + through_a[group_b]
        written = np.empty(2 * (len(a) + len(b)), object)
        written[1::2] = ","
        written[2 * place_a], written[2 * place_b] = self.names[a], self.names[b]
        written[2 * place_a[close_a] + 1], written[2 * place_b[close_b] + 1] = "|", ";"
        written[2 * place_b[final] + 1] = "\n"
        self.groups.extend("".join(written.tolist()).split("\n")[:-1])


class Aligner:
    """Encodes documents and keeps the alignments of windows; what is kept is bounded."""

    def __init__(self, a: ByteVocabulary, b: PieceVocabulary, kept: int = KEPT):
        self.a, self.b, self.kept = a, b, kept
        self.of_a, self.of_b = TokenBytes(a.bytes), TokenBytes(b.bytes)
        self.forget()

    def forget(self) -> None:
        self.known = Windows(self.of_a, self.of_b)

    def windows(self, text: bytes, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The numbers of a text's windows in order; none where the tokens' bytes differ from space+text."""
        full = np.frombuffer(b" " + text, np.uint8)
        if not self.of_a.spell(a, full) or not self.of_b.spell(b, full):
            return []
        start_a, start_b = self.of_a.ends(a) - self.of_a.size[a], self.of_b.ends(b) - self.of_b.size[b]
        at_a, at_b = np.flatnonzero(self.of_a.marked[a]), np.flatnonzero(self.of_b.marked[b])
        begun = np.zeros((2, len(full)), bool)
        begun[0, start_a[at_a]] = begun[1, start_b[at_b]] = True
        cut_a, cut_b = at_a[begun[1, start_a[at_a]]], at_b[begun[0, start_b[at_b]]]
        # Both begin at 0 in any case.
        if not len(cut_a) or cut_a[0]:
            cut_a, cut_b = np.append(0, cut_a), np.append(0, cut_b)
        # A window's key: its ids of A, the mark, its ids of B; all keys stand behind each other.
        n = len(cut_a)
        size_a, size_b = np.diff(np.append(cut_a, len(a))), np.diff(np.append(cut_b, len(b)))
        keys = np.empty(len(a) + len(b) + n, "<u4")
        keys[np.arange(len(a)) + np.repeat(cut_b + np.arange(n), size_a)] = a
        keys[cut_a + cut_b + np.arange(n) + size_a] = MARK
        keys[np.arange(len(b)) + np.repeat(cut_a + size_a + np.arange(n) + 1, size_b)] = b
        raw, ends = keys.tobytes(), (np.cumsum(size_a + size_b + 1) * 4).tolist()
        return list(map(self.known.__getitem__, [raw[i:k] for i, k in zip([0, *ends], ends)]))

    def slice(self, number: int, keys: list, documents: list[bytes], together: int = 300_000) -> Iterator[tuple]:
        """A row for each document, with the windows it uses, then the slice's own row with its pairs.

        Windows are numbered anew in each slice; ``together`` bytes of text are encoded at a time.
        """
        if len(self.known.codes) > self.kept:
            self.forget()
        known, place, order, often = self.known, np.zeros(0, np.int64), [], np.zeros(0, np.int64)
        size = 0
        for at in _parts(documents, together):
            texts_of = [t.decode() for t in documents[at]]
            encoded = list(zip(self.a.encode([" " + t for t in texts_of]), self.b.encode(texts_of)))
            windows = [self.windows(text, a, b) if text else [] for text, (a, b) in zip(documents[at], encoded)]
            known.learn()
            for key, (a, b), found in zip(keys[at], encoded, windows):
                some, times = np.unique(np.array(found, np.int64), return_counts=True)
                if len(known.groups) > len(place):
                    place = np.append(place, np.full(len(known.groups) * 3 // 2 - len(place), -1))
                    often = np.append(often, np.zeros(len(place) - len(often), np.int64))
                new = some[place[some] < 0]
                place[new] = np.arange(size, size + len(new))
                size += len(new)
                order.append(new)
                often[some] += times
                groups = ";".join(map(known.groups.__getitem__, found))
                n_a, n_b, n_groups = (len(a), len(b), groups.count("|")) if found else (0, 0, 0)
                # Within a group no two tokens end together but the last, so its pairs are its tokens less one.
                yield key, n_a, n_b, n_groups, n_a + n_b - n_groups, groups, number, place[some], times
        used = np.concatenate([*order, np.zeros(0, np.int64)])
        n_links = np.array(known.n_links, np.int64)
        sizes = n_links[used]
        ends = np.cumsum(sizes)
        at = np.repeat((np.cumsum(n_links) - n_links)[used] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        pairs, places = np.unique(np.array(known.codes, np.int64)[at], return_inverse=True)
        links = np.bincount(places, np.repeat(often[used], sizes), len(pairs)).astype(np.int64)
        yield number, sizes, places.astype(np.uint32), pairs, links


def _parts(documents: list[bytes], limit: int) -> Iterator[slice]:
    """Ranges of documents of ``limit`` bytes each, or of one document."""
    begin = size = 0
    for at, text in enumerate(documents):
        size += len(text)
        if size >= limit:
            yield slice(begin, at + 1)
            begin, size = at + 1, 0
    if begin < len(documents):
        yield slice(begin, len(documents))


def bounded(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of rows, as many as have ``limit`` bytes of text together."""
    keys, held, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys.append(key)
            held.append(text.as_py())
            size += len(held[-1])
            if size >= limit:
                yield keys, held
                keys, held, size = [], [], 0
    if keys:
        yield keys, held


@functools.lru_cache(1)
def _aligner(path_a: str, pattern: str, path_b: str) -> Aligner:
    """One for each worker process, whose windows serve all its tasks."""
    return Aligner(ByteVocabulary(path_a, pattern), PieceVocabulary(path_b))


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Documents' tokens and ``groups`` (``a1,a2|b1;a3|b2``), with a row for each slice that ``counted`` needs.

    The paths are files that every executor can read; ``pattern`` splits texts for tokenizer A. Stage the result
    (with fewer columns, or digests of them) before ``counted``: slices are named by the task that made them.
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "slice", "used", "times", "sizes", "places", "pairs", "links"]
    i64, raw, longs = pa.int64(), pa.binary(), pa.list_(pa.int64())
    kinds = [i64, i64, i64, i64, i64, pa.string(), i64, raw, raw, raw, raw, longs, longs]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, pattern, path_b)
        first = TaskContext.get().partitionId() << 24
        for n, (keys, held) in enumerate(bounded(batches, slice_bytes)):
            rows, size = [], 0
            for row in aligner.slice(first + n, keys, held):
                if len(row) == 9:
                    rows.append((*row[:7], pack(row[7].astype(np.uint32)), pack(row[8].astype(np.uint32)), None, None, None, None))
                else:
                    number, sizes, places, pairs, links = row
                    rows.append((*[None] * 6, number, None, None, pack(sizes.astype(np.uint32)), pack(places), pairs, links))
                size += len(row[5]) if len(row) == 9 else 0
                if size > 1_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: links of each id pair in the corpus, and whether its B id has no pair with more."""
    each = aligned.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("x.pairs", "x.links")
    counts = stage(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("links").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def counted(aligned: DataFrame) -> DataFrame:
    """The document rows of a staged ``align`` with ``n_best`` and ``count_sum``."""
    asked = aligned.filter("pairs IS NOT NULL").select(F.col("slice").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(aligned), "pair").select("of", "place", "count", "best")
    fields = COUNTED.split(", ")
    names = [f.split()[0] for f in fields]

    def look(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        own = next(i for i, x in enumerate(rows.column("sizes").to_pylist()) if x is not None)
        sizes = unpack(rows.column("sizes")[own].as_py(), np.uint32).astype(np.int64)
        places = unpack(rows.column("places")[own].as_py(), np.uint32)
        count, best = np.zeros((2, told.num_rows), np.int64)
        at = told.column("place").to_numpy()
        count[at], best[at] = told.column("count").to_numpy(), told.column("best").to_numpy()
        starts = np.cumsum(sizes) - sizes
        of = {n: np.add.reduceat(v[places], starts) if len(sizes) else sizes for n, v in (("count_sum", count), ("n_best", best))}
        kept = rows.filter(pc.is_null(rows.column("sizes")))
        sums: dict[str, list[int]] = {"n_best": [], "count_sum": []}
        for used, times in zip(kept.column("used"), kept.column("times")):
            which, often = unpack(used.as_py(), np.uint32), unpack(times.as_py(), np.uint32).astype(np.int64)
            for n, column in sums.items():
                column.append(int((of[n][which] * often).sum()))
        return pa.table([*(kept.column(n).combine_chunks() for n in names[:6]), *(pa.array(sums[n], pa.int64()) for n in names[6:])], names=names)

    rows = aligned.select(*names[:6], "slice", "used", "times", "sizes", "places")
    return rows.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(look, COUNTED)
