"""Benchmark items in documents: pigeonhole pieces found exactly, matches verified by Myers' bit-parallel distance.

Texts are compared after A-Z became lower case and each run of ASCII white space one space. An item of m
characters may differ by ``k = floor(m * error_rate)`` insertions, deletions and replacements from a
passage of a document. It is split into k + 1 pieces; k errors leave one of them intact, so every match has
an exact piece. One automaton finds the pieces of all items in a whole text; around each hit the distance
to the best passage is computed with one bit for each character of the item.

The items are sent to all tasks in slices of about ``SLICE_BYTES``, with one pass over the documents for each
slice. The driver holds one slice at a time: with several, each pass is written before the next slice is
fetched. The documents are not shuffled, except where ``drop_contaminated`` has several slices and joins the
digests of the texts that are to go.

Defined cases: a null or empty text matches nothing; null or empty items match nothing; equal items are
found each under its own id; rows with a null id come out with a null id; repeated rows repeat. A document
comes out once for each item. Empty tables give empty results. Only ``doc_id, text`` and ``item_id, text``
are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import parts, text_bytes, texts
from demandlens.session import stage

ERROR_RATE = 0.08
#: Bytes of items that are sent to the tasks at once.
SLICE_BYTES = 4_000_000
HITS = "doc_id long, item_id long, distance long, budget long, start long, end long"


def normalise(text: bytes) -> str:
    return b" ".join(text.lower().split()).decode("utf-8", "replace")


def pieces(text: str, budget: int) -> list[tuple[str, int]]:
    """``budget + 1`` pieces of nearly equal length, with where they start."""
    cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(text[a:z], a) for a, z in zip(cuts, cuts[1:]) if z > a]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def best_end(pattern: str, bits: dict[str, int], text: str) -> tuple[int, int]:
    """The least distance between ``pattern`` and a passage of ``text``, and the first end that has it."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        # A match may start anywhere, so no bit comes in from the text's side.
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, end = score, at
    return best, end


class Items:
    """The automaton over the pieces of a slice of items."""

    def __init__(self, rows: list[tuple[int | None, bytes]], error_rate: float):
        import ahocorasick

        self.items: list[tuple[list, str, int, dict[str, int]]] = []
        by_text: dict[str, list] = defaultdict(list)
        for key, text in rows:
            if value := normalise(text):
                by_text[value].append(key)
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for text, keys in by_text.items():
            budget = int(len(text) * error_rate)
            for piece, at in pieces(text, budget):
                places[piece].append((len(self.items), at))
            self.items.append((keys, text, budget, masks(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple]:
        """``item, distance, budget, start, end``, the best passage of each item that matches."""
        spans: dict[int, list[list[int]]] = defaultdict(list)
        if not self.items:
            return
        for last, (size, found) in self.automaton.iter(text):
            for item, at in found:
                budget, length = self.items[item][2], len(self.items[item][1])
                start = last + 1 - size - at - budget
                end = start + length + 2 * budget
                held = spans[item]
                if held and start <= held[-1][1] and start >= held[-1][0]:
                    held[-1][1] = max(held[-1][1], end)
                else:
                    held.append([start, end])
        for item, held in spans.items():
            keys, pattern, budget, bits = self.items[item]
            best = None
            for start, end in held:
                start = max(0, start)
                window = text[start:end]
                at = window.find(pattern)
                distance, stop = (0, at + len(pattern)) if at >= 0 else best_end(pattern, bits, window)
                if distance <= budget and (best is None or distance < best[0]):
                    # The same search backwards from the end gives where the passage starts.
                    back = window[max(0, stop - len(pattern) - budget) : stop][::-1]
                    size = len(pattern) if at >= 0 else best_end(pattern[::-1], masks(pattern[::-1]), back)[1]
                    best = (distance, start + stop - size, start + stop)
                if distance == 0:
                    break
            if best:
                for key in keys:
                    yield key, best[0], budget, best[1], best[2]


def _slices(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items with the number of their slice, and how many slices there are."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    number = parts(text_bytes(items), SLICE_BYTES)
    return items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(number))), number


def _send(items: DataFrame, number: int):
    """One slice as a broadcast."""
    rows = [(r["item_id"], bytes(r["text"])) for r in items.filter(F.col("slice") == number).collect()]
    return items.sparkSession.sparkContext.broadcast(rows)


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """``doc_id, item_id, distance, budget, start, end``; places count characters of the normalised text."""
    items, number = _slices(benchmark)
    if number == 1:
        return _search(docs, _send(items, 0), error_rate)
    out = None
    for i in range(number):
        sent = _send(items, i)
        found = stage(_search(docs, sent, error_rate), "matches")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, rows, error_rate: float) -> DataFrame:
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "item_id", "distance", "budget", "start", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Items(rows.value, error_rate).search
        for batch in batches:
            out = [
                (key, *hit)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1))
                for hit in search(normalise(text.as_py()))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], schema=schema)

    return texts(docs).mapInArrow(run, HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all columns.

    The search is a pure function of the text. With one slice it marks each row where it is read and nothing
    is joined; with several the texts that go are gathered by their digests.
    """
    items, number = _slices(benchmark)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    if number == 1:
        return docs.filter(~_flag(_send(items, 0), error_rate)(text))
    gone = None
    for i in range(number):
        sent = _send(items, i)
        found = docs.filter(_flag(sent, error_rate)(text)).select(F.sha2(text, 256).alias("gone")).distinct()
        found = stage(found, "contaminated")
        sent.destroy()
        gone = found if gone is None else gone.unionByName(found)
    packed = docs.select(F.struct("*").alias("doc"))
    own = F.sha2(F.coalesce(F.col("doc.text"), F.lit("")).cast("binary"), 256)
    return packed.join(gone.distinct(), own == F.col("gone"), "left_anti").select("doc.*")


def _flag(rows, error_rate: float):
    @F.arrow_udf("boolean")
    def contaminated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = Items(rows.value, error_rate).search
        for batch in batches:
            yield pa.array([any(True for _ in search(normalise(t.as_py()))) for t in batch], pa.bool_())

    return contaminated
