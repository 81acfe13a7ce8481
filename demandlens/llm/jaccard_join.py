"""Documents whose sets of word shingles are similar: T-occurrence search with DivideSkip.

A-Z is lower-cased; a document's set is its distinct shingles of ``words`` words. Two documents link when
100 * |x & y| >= percent * |x | y|. The steps:

1. Equal sets become one class, so copies are never compared or expanded.
2. A sketch of fixed size counts shingles. Each class posts the rarest shingles of its set, as many as a
   linked set can't all lack (n - ceil(percent% of n) + 1). Linked classes share a posted shingle.
3. In every inverted list the class with the fewest lone shingles is the pivot; all others of the list
   are candidates against it. Links to pivots put most of a group of near copies into one component.
4. Only pairs of one list whose components still differ are candidates then, so a group of near copies
   never becomes all its pairs, and no pair that could join two components is left out.

Candidates are searched where the documents are: the probe's text, compressed, goes to each chunk that holds
candidates of it, once (a text is a third as large as its hashed shingles); the chunk has an inverted index of
these and merges the probe's short lists, keeps what occurs often enough and probes the long lists by binary
search (DivideSkip). Components are found by joins.

Defined cases: a null text, or one without words, has an empty set and links with nothing; with fewer than
``words`` words the whole sequence is the only shingle. Rows without an id take part in no link and are
their own component (null). Rows that share an id share its component. Empty tables give empty results.
Only ``doc_id`` and ``text`` are read, except by ``keep_first``, which returns whole rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import WordHash, chunked, distinct, mix, pack, parts, text_bytes, texts, unpack, windows
from demandlens.session import stage, unstage

WORDS, PERCENT = 3, 90
#: Counters of the sketch, and the slices that they travel in: 4 MB for a task and for the broadcast.
COUNTERS, SLICES = 1 << 20, 16
CHUNK_BYTES = 6_000_000
#: DivideSkip's weight of the number of long lists (fixed value).
MU = 0.0085

_SETS = "doc_id long, n long, digest binary, lone long, posted array<long>"


@functools.lru_cache(1)
def _hashes() -> WordHash:
    return WordHash()


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    values = _hashes().of(found)
    return distinct(windows(values, words) if len(values) >= words else mix(windows(values, len(values)) + np.uint64(len(values))))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def count_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents have a shingle of each cell, over all documents."""
    size = COUNTERS // SLICES

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, size_of = np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(_cell(shingles(text.as_py(), words)))
                size_of += len(held[-1])
                if size_of > COUNTERS:
                    sums += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size_of = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([pack(sums[i * size : (i + 1) * size]) for i in range(SLICES)])], names=["slice", "sums"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(x.as_py(), np.int64) for x in table.column("sums"))
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "sums": pa.array([pack(total)])})

    parts_of = texts(docs).select("text").mapInArrow(local, "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary")
    sums = np.zeros(COUNTERS, np.int64)
    for number, data in parts_of.collect():
        sums[number * size : (number + 1) * size] = unpack(bytes(data), np.int64)
    return sums


def least_overlap(n: int, percent: int) -> int:
    """What a linked set shares with a set of ``n`` at least."""
    return -(-n * percent // 100)


def describe(docs: DataFrame, counters: np.ndarray, words: int, percent: int) -> DataFrame:
    """``doc_id, n, digest, lone, posted`` of every document with an id; posted shingles are the rarest, in order."""
    sent = docs.sparkSession.sparkContext.broadcast(counters.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py(), words)
                often = count[_cell(found)]
                n = len(found)
                rarest = np.lexsort((found, often))[: n - least_overlap(n, percent) + 1 if n else 0]
                digest = xxhash.xxh3_128_digest(found.tobytes())
                rows.append((key, n, digest, int((often <= 1).sum()), found[rarest].view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "n", "digest", "lone", "posted"]
            )

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SETS)


class Index:
    """Inverted lists of a chunk's candidates."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.n = np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64)
        keys = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(keys, kind="stable")
        keys, self.owner = keys[order], owner[order]
        self.keys, self.start = np.unique(keys, return_index=True)
        self.end = np.append(self.start[1:], len(keys))
        # Each list's entries as one rising sequence, so that many binary searches are one call.
        self.entry = np.repeat(np.arange(len(self.keys)), self.end - self.start) * len(ids) + self.owner

    def search(self, probe: np.ndarray, percent: int) -> np.ndarray:
        """Which candidates share enough of the probe's shingles."""
        at = np.searchsorted(self.keys, probe)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probe)] if len(self.keys) else at[:0]
        least = least_overlap(len(probe), percent)
        if len(at) < least:
            return np.zeros(0, np.int64)
        length = self.end[at] - self.start[at]
        at = at[np.argsort(length, kind="stable")]
        long = min(int(least / (MU * math.log2(max(2, length.max())) + 1)), least - 1)
        short, lists = at[: len(at) - long], at[len(at) - long :]
        sizes = self.end[short] - self.start[short]
        ends = np.cumsum(sizes)
        merged = self.owner[np.repeat(self.start[short] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        often = np.bincount(merged, minlength=len(self.ids))
        found = np.flatnonzero(often >= max(1, least - long))
        fits = (self.n[found] * 100 >= len(probe) * percent) & (self.n[found] * percent <= len(probe) * 100)
        found = found[fits]
        shared = often[found]
        for some in np.array_split(lists, max(1, len(lists) * len(found) // 1_000_000)):
            wanted = some[:, None] * len(self.ids) + found[None, :]
            place = np.minimum(np.searchsorted(self.entry, wanted), len(self.entry) - 1)
            shared = shared + (self.entry[place] == wanted).sum(axis=0)
        return found[shared * 100 >= percent * (self.n[found] + len(probe) - shared)]


def spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect the same ids, one for each id at most."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = above[x]
        return x

    kept = []
    for a, b in links:
        first, second = top(a), top(b)
        if first != second:
            above[second] = first
            kept.append((a, b))
    return kept


def compressed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    press = zstandard.ZstdCompressor()
    for batch in batches:
        yield pa.array([press.compress(x.as_py()) for x in batch], pa.binary())


def _rank(found: np.ndarray) -> tuple[int, bytes]:
    """Of rows that share an id the larger set speaks for it, as in ``similar``."""
    return len(found), xxhash.xxh3_128_digest(found.tobytes())


def search(docs: DataFrame, pairs: DataFrame, words: int, percent: int, size: int) -> DataFrame:
    """Links ``a, b`` that connect whatever links of the candidate ``pairs`` connect.

    A chunk gives a spanning set of the links that it finds, so a group of near copies gives as many links
    as it has members, not as pairs.
    """
    chunks = parts(size, CHUNK_BYTES)
    table = chunked(docs, chunks).withColumn("text", F.arrow_udf(compressed, "binary")("text"))
    number = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(chunks)).cast("int")
    asked = pairs.select("a", "b", number("a").alias("chunk"), number("b").alias("goal"))
    probes = asked.select("chunk", "a", "goal").distinct()
    goals = asked.select(F.col("goal").alias("chunk"), "a", "b")

    def opened(text: bytes) -> np.ndarray:
        return shingles(zstandard.ZstdDecompressor().decompress(text), words)

    def read(rows: pa.Table, wanted: set) -> dict[int, bytes]:
        found: dict[int, list[bytes]] = {}
        for key, text in zip(rows.column("doc_id").to_pylist(), rows.column("text")):
            if key in wanted:
                found.setdefault(key, []).append(text.as_py())
        return {key: some[0] if len(some) == 1 else max(some, key=lambda t: _rank(opened(t))) for key, some in found.items()}

    def send(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        held = read(rows, set(wanted.column("a").to_pylist())) if wanted.num_rows and rows.num_rows else {}
        out = [(g, a, held[a]) for a, g in zip(wanted.column("a").to_pylist(), wanted.column("goal").to_pylist()) if a in held]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["chunk", "a", "probe"])

    def look(rows: pa.Table, sent: pa.Table) -> pa.Table:
        links = []
        if rows.num_rows and sent.num_rows:
            held = read(rows, set(sent.column("b").to_pylist()) - {None})
            index = Index(list(held), [opened(t) for t in held.values()])
            for a, probe in zip(sent.column("a").to_pylist(), sent.column("probe")):
                if probe.is_valid:
                    links.extend((a, int(b)) for b in index.ids[index.search(opened(probe.as_py()), percent)] if b != a)
            links = spanning(links)
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["a", "b"])

    asking = table.groupBy("chunk").cogroup(probes.groupBy("chunk")).applyInArrow(send, "chunk int, a long, probe binary")
    to = asking.select("chunk", "a", F.lit(None).cast("long").alias("b"), "probe").unionByName(
        goals.select("chunk", F.lit(None).cast("long").alias("a"), "b", F.lit(None).cast("binary").alias("probe")).distinct()
    )
    return table.groupBy("chunk").cogroup(to.groupBy("chunk")).applyInArrow(look, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id that links reach) of every id in ``links`` of ``a, b``."""
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    at = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "component")
    while True:
        near = both.join(at.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = at.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        # Then each takes what its component's own component is.
        jump = at.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        moved = stage(
            lower.join(jump, "next", "left").select(
                "id", F.least("next", F.coalesce("beyond", "next")).alias("component"), F.col("component").alias("before")
            ),
            "component",
        )
        at = moved.select("id", "component")
        if moved.filter("component < before").isEmpty():
            return at


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``."""
    size = text_bytes(docs)
    seen = stage(describe(docs, count_shingles(docs, words), words, percent), "sets")
    # A class: documents with equal sets. Of rows that share an id, the larger set speaks for it.
    alone = seen.filter("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.max(F.struct("n", "digest")).alias("set"))
    members = stage(alone.select("doc_id", F.col("set.digest").alias("digest")), "members")
    first = members.groupBy("digest").agg(F.min("doc_id").alias("id"))
    about = seen.filter("doc_id IS NOT NULL AND n > 0").select(F.col("doc_id").alias("id"), "digest", "n", "lone", "posted")
    classes = first.join(about, ["id", "digest"]).dropDuplicates(["id"])
    posted = stage(classes.select("id", "n", "lone", F.posexplode("posted").alias("at", "shingle")), "posted")
    first = stage(first, "first")
    # The posted lists are the bulk of the sets; from here on only their sizes are read.
    sizes = stage(seen.select("doc_id", "n"), "sizes")
    unstage(seen)
    lists = posted.groupBy("shingle").agg(F.count("*").alias("size"), F.min(F.struct(F.col("lone") / F.col("n"), "id", "n")).alias("pivot"))
    lists = lists.filter("size > 1").select("shingle", F.col("pivot.id").alias("a"), F.col("pivot.n").alias("n_a"))
    close = F.expr(f"100 * least(n, n_a) >= {percent} * greatest(n, n_a)")
    listed = stage(posted.join(lists, "shingle"), "lists")
    unstage(posted)
    stars = listed.filter("id <> a").filter(close).select("a", F.col("id").alias("b")).distinct()
    links = stage(search(docs, stars, words, percent, size), "links")
    at = components(links)
    # Pairs that share a list and could still join two components, apart from those with a pivot.
    labelled = listed.join(at, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_lists = stage(labelled.filter("id <> a").join(mixed.select("shingle"), "shingle", "left_semi").select("shingle", "id", "n", "at", "component"), "open")
    unstage(listed)
    left = open_lists.select("shingle", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("component").alias("c_a"))
    # After this shingle both have at most so many in common.
    reach = F.expr(f"least(n - at, n_a - at_a) * {100 + percent} >= {percent} * (n + n_a)")
    rest = left.join(open_lists, "shingle").filter("a < id AND c_a <> component").filter(close).filter(reach)
    pairs = stage(rest.select("a", F.col("id").alias("b")).distinct(), "pairs")
    if not pairs.isEmpty():
        at = components(links.unionByName(stage(search(docs, pairs, words, percent, size), "links")))
    class_of = members.join(first, "digest").join(at, "id", "left")
    reached = class_of.select(F.col("doc_id").alias("key"), F.coalesce("component", "id").alias("found"))
    out = sizes.join(reached, F.col("doc_id") == F.col("key"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay.

    Rows that share an id but not their text are compared and dropped each for itself; of these the
    smallest key stays where the ids are equal.
    """
    packed = docs.select(F.struct("*").alias("doc"))
    shared = stage(shared_ids(docs), "shared")
    if shared.isEmpty():
        out = similar(docs, words, percent)
        gone = out.filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
        return packed.join(gone, F.col("doc.doc_id") == F.col("gone"), "left_anti").select("doc.*")
    number = F.col("doc.doc_id").cast("long")
    own = F.xxhash64("id", F.coalesce(F.col("doc.text"), F.lit("")))
    key = F.when(F.col("id").isNotNull(), own).otherwise(number).alias("key")
    keyed = stage(packed.join(shared, number == F.col("id"), "left").select("doc", key), "keyed")
    out = similar(keyed.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text")), words, percent)
    ids = keyed.filter("key IS NOT NULL").select("key", number.alias("id")).distinct()
    at = stage(out.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key"), "rows")
    first = at.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"))
    gone = at.join(first, "component_id").filter("key <> first.key").select(F.col("key").alias("gone"))
    return keyed.join(gone, F.col("key") == F.col("gone"), "left_anti").select("doc.*")


def shared_ids(docs: DataFrame) -> DataFrame:
    """``id`` of rows that have different texts."""
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    each = docs.select(F.col("doc_id").cast("long").alias("id"), digest.alias("digest")).filter("id IS NOT NULL")
    return each.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("id")
