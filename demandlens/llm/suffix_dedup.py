"""Repeated byte strings: suffixes are sorted only through ``length`` bytes, by passes over ever deeper digits.

Equal groups after the last pass are the strings of ``length`` bytes that occur twice or more; every byte
that such a string covers goes. The passes:

1. The first digit of a string is its anchor, the 16 bytes in it with the smallest hash (the leftmost of
   equals). Equal strings have equal anchors at the same offset, and neighbouring strings mostly share
   theirs, so a document has about two anchors in ``length`` bytes. Anchors that occur once leave here;
   chunks send them to buckets packed, each once.
2. Runs of strings with one anchor go to the anchor's bucket as the bytes they span (``context``). Equal
   contexts of a chunk are sent once, with the places they stand for, so copies cost one row a chunk.
3. A bucket sorts its strings by offset and by hashes of digits of 50 bytes each; what is alone in its
   group after a pass leaves. The bytes of the strings of a last group are compared then, whole runs at a
   time, so strings whose hashes agree by chance or by design are told apart.
4. An anchor with more than ``HOT_RUNS`` runs (a short passage that a third of all documents share) would
   make its bucket large. Its strings take all digits at once: a chunk sends each distinct one's 64-bit hash
   and 128-bit BLAKE2 digest to the bucket of the hash's range, so such a group is spread over all buckets.
   Equal digests stand for equal bytes there.

The places of what is left go back to the documents. Chunks and buckets are bounded by the number of
bytes, the texts are shuffled once, and all passes read that shuffle.

Defined cases: a null text is empty; texts shorter than ``length`` stay whole; matches never cross
documents and may overlap; equal texts lose all bytes, whatever their ids; rows without an id are like any
other. Empty tables give empty results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from demandlens.llm.common import chunked, mix, pack, parts, text_bytes, unpack, windows
from demandlens.llm.substring_dedup import BIN, INT, LONG, cuts, ranges, table_of

LENGTH = 200
#: Bytes of an anchor and of each later digit.
ANCHOR, DIGIT = 16, 50
CHUNK_BYTES, BUCKET_BYTES = 6_000_000, 2_000_000
#: Strings of a document that are looked at together; positions in such a part take 20 bits.
PART = 500_000
#: Runs of one anchor that a bucket sorts together, about 3 MB of contexts.
HOT_RUNS = 10_000

_ANCHORS = "bucket int, chunk int, hashes binary, runs binary"
_KINDS = "chunk int, bucket int, kinds binary"
_CONTEXTS = (
    "bucket int, chunk int, anchor long, offset int, context binary, docs binary, places binary, "
    "strings binary, often binary, digests binary"
)
_RUNS = "chunk int, docs binary, starts binary, ends binary, strings binary, digests binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def anchors(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of strings that share an anchor: hash of the anchor, its place, first string, end of the run."""
    width = length - ANCHOR + 1
    for begin in range(0, len(data) - length + 1, PART):
        part = data[begin : begin + PART + length - 1]
        grams = windows(part, ANCHOR)
        # The place in the low bits makes each key different and the leftmost of equals the smallest.
        keys = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
        padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(keys) - width + 1
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        at = place[first]
        # Smallest hashes are small; buckets are ranges, so they are mixed once more.
        yield mix(grams[at]), at + begin, first + begin, np.append(first[1:], n) + begin


def _doc_key(doc_id: int | None, text: bytes) -> int:
    """The same for rows with the same id and text only."""
    return xxhash.xxh3_64_intdigest(text, seed=0 if doc_id is None else (doc_id + 1) % 2**64)


def _rows(table: pa.Table) -> Iterator[tuple[int | None, bytes]]:
    for key, text in zip(table.column("doc_id").to_pylist(), table.column("text")):
        yield key, text.as_py()


def _by_anchor(anchors_of: np.ndarray, sizes: np.ndarray, limit: int = 500_000) -> Iterator[slice]:
    """Slices of whole anchors, of ``limit`` bytes each or one anchor."""
    bounds = [*(np.flatnonzero(np.diff(anchors_of)) + 1).tolist(), len(sizes)]
    before = np.append(0, np.cumsum(sizes))
    begin = at = 0
    for end in bounds:
        if before[end] - before[begin] > limit and at > begin:
            yield slice(begin, at)
            begin = at
        at = end
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _repeated(
    data: bytes, sizes: np.ndarray, anchor: np.ndarray, offset: np.ndarray, weight: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first and last string of the runs of strings that are not alone, by passes over the digits."""
    values = np.frombuffer(data, np.uint8)
    digits = np.empty(max(0, len(values) - DIGIT + 1), np.uint64)
    for begin in range(0, len(digits), PART):
        part = windows(values[begin : begin + PART + DIGIT - 1], DIGIT)
        digits[begin : begin + len(part)] = part
    n = sizes - length + 1
    total = int(n.sum())
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(np.cumsum(sizes) - sizes, n) + step
    group = mix(anchor[owner] + mix((offset[owner] - step).astype(np.uint64)))
    active = np.arange(total)
    for depth in [*range(0, length - DIGIT, DIGIT), length - DIGIT]:
        group = mix(group + digits[place[active] + depth])
        order = np.argsort(group)
        ordered = group[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[: len(order)]
        each = np.add.reduceat(weight[owner[active[order]]], starts) if len(order) else starts
        stays = order[np.repeat(each > 1, np.diff(np.append(starts, len(order))))]
        stays.sort()
        active, group = active[stays], group[stays]
    active = active[_confirmed(values, place[active], group, weight[owner[active]], length)]
    if not len(active):
        return active, active, active
    cut = np.flatnonzero((np.diff(active) != 1) | (np.diff(owner[active]) != 0))
    first, last = active[np.append(0, cut + 1)], active[np.append(cut, len(active) - 1)]
    return owner[first], step[first], step[last]


def _confirmed(values: np.ndarray, place: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings at ``place`` occur twice, by their bytes; ``group`` is equal for equal strings."""
    if not len(place):
        return np.zeros(0, bool)
    _, first, number = np.unique(group, return_index=True, return_inverse=True)
    to = place[first][number]
    # Neighbours whose group's first strings are neighbours too are compared as one run of bytes.
    starts = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(to) != 1)))
    ends = np.append(starts[1:], len(place))
    differ = np.zeros(len(first), bool)
    for s, e, a, b in zip(starts.tolist(), ends.tolist(), place[starts].tolist(), to[starts].tolist()):
        if a != b:
            unequal = values[a : a + e - s + length - 1] != values[b : b + e - s + length - 1]
            if unequal.any():
                near = np.cumsum(np.append(0, unequal))
                differ[number[s:e][near[length:] > near[: e - s]]] = True
    out = np.ones(len(place), bool)
    mixed = np.flatnonzero(differ[number])
    strings = [values[i : i + length].tobytes() for i in place[mixed].tolist()]
    often: Counter[bytes] = Counter()
    for text, n in zip(strings, weight[mixed].tolist()):
        often[text] += n
    out[mixed] = [often[text] > 1 for text in strings]
    return out


#: Kinds of anchors: one run only, several, too many for a bucket.
ALONE, SEVERAL, HOT = 0, 1, 2


def _kinds(table: pa.Table, hot_runs: int) -> pa.Table:
    """For each chunk's sorted anchors in a bucket, one byte each: their kind over all chunks."""
    bucket = table.column("bucket")[0].as_py()
    sent = [unpack(x.as_py()) for x in table.column("hashes")]
    runs = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("runs")])
    _, group = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(group, runs)[group]
    kinds = ((total > 1).astype(np.uint8) + (total > hot_runs)).astype(np.uint8)
    ends = np.cumsum([len(x) for x in sent])
    rows = [(c.as_py(), bucket, kinds[e - len(x) : e].tobytes()) for c, x, e in zip(table.column("chunk"), sent, ends)]
    return table_of({"chunk": INT, "bucket": INT, "kinds": BIN}, rows)


def _digests(text: bytes, places: np.ndarray, length: int) -> np.ndarray:
    """The digests of the strings at ``places``, 16 bytes each."""
    return np.frombuffer(b"".join(blake2b(text[i : i + length], digest_size=16).digest() for i in places.tolist()), "V16")


def _repeated_strings(table: pa.Table) -> list[tuple[int, bytes, bytes]]:
    """Per chunk, which of the strings it sent occur twice or more over all chunks: hashes and digests."""
    if not table.num_rows:
        return []
    sent = [np.frombuffer(x.as_py(), "V16") for x in table.column("digests")]
    hashes = [unpack(x.as_py()) for x in table.column("strings")]
    often = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("often")])
    _, group = np.unique(np.concatenate(sent), return_inverse=True)
    twice = (np.bincount(group, often) > 1)[group]
    ends = np.cumsum([len(x) for x in sent])
    out = []
    for chunk, h, d, end in zip(table.column("chunk").to_pylist(), hashes, sent, ends):
        kept = twice[end - len(d) : end]
        if kept.any():
            out.append((chunk, pack(h[kept]), d[kept].tobytes()))
    return out


def _places(text: bytes, strings: np.ndarray, digests: set[bytes], length: int) -> Iterator[np.ndarray]:
    """Where one of the strings of sorted hashes and ``digests`` starts, by parts of the text."""
    data = np.frombuffer(text, np.uint8)
    for begin in range(0, len(data) - length + 1 if len(strings) else 0, PART):
        here = windows(data[begin : begin + PART + length - 1], length)
        at = np.searchsorted(strings, here)
        found = np.flatnonzero(strings[np.minimum(at, len(strings) - 1)] == here) + begin
        yield found[[x.tobytes() in digests for x in _digests(text, found, length)]] if len(found) else found


def cut_repeats(docs: DataFrame, length: int = LENGTH, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left)."""
    if length < ANCHOR + DIGIT:
        raise ValueError(f"length must be {ANCHOR + DIGIT} at least")
    size = text_bytes(docs)
    buckets = parts(size, BUCKET_BYTES)
    chunks = chunked(docs, parts(size, CHUNK_BYTES), by_text=True)

    def first_digits(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        found = [a[0] for _, t in _rows(table) for a in anchors(np.frombuffer(t, np.uint8), length)]
        found, runs = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
        rows = [(b, number, pack(found[s]), pack(runs[s].astype(np.uint32))) for b, s in cuts(ranges(found, buckets), buckets)]
        return table_of({"bucket": INT, "chunk": INT, "hashes": BIN, "runs": BIN}, rows)

    def contexts(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = {"bucket": INT, "chunk": INT, "anchor": LONG, "offset": INT, "context": BIN, "docs": BIN, "places": BIN, "strings": BIN, "often": BIN, "digests": BIN}
        if not table.num_rows or not answers.num_rows:
            return table_of(schema, [])
        number = table.column("chunk")[0].as_py()
        held = []
        for i, (key, text) in enumerate(_rows(table)):
            for hashes, at, first, end in anchors(np.frombuffer(text, np.uint8), length):
                held.append((i, key, hashes, at - first, first, end))
        if not held:
            return table_of(schema, [])
        hashes = np.concatenate([h[2] for h in held])
        found, group = np.unique(hashes, return_inverse=True)
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("kinds").to_pylist()))
        kinds = [np.frombuffer(told[b], np.uint8) for b, _ in cuts(ranges(found, buckets), buckets)]
        kind, end_of = np.concatenate(kinds)[group], 0
        column = table.column("text")
        seen: dict[tuple[int, int, bytes], tuple[list, list]] = defaultdict(lambda: ([], []))
        strings, digests = [np.zeros(0, np.uint64)], [np.zeros(0, "V16")]
        for i, key, hashes, offset, first, end in held:
            here = kind[end_of : end_of + len(hashes)]
            some, hot = np.flatnonzero(here == SEVERAL), here == HOT
            end_of += len(hashes)
            if hot.any():
                text = column[i].as_py()
                part = np.frombuffer(text, np.uint8)[first[0] : end[-1] + length - 1]
                places_of = np.flatnonzero(np.repeat(hot, end - first))
                strings.append(windows(part, length)[places_of])
                digests.append(_digests(text, places_of + first[0], length))
            if len(some):
                text = column[i].as_py()
                doc = _doc_key(key, text)
                for h, o, f, e in zip(hashes[some].tolist(), offset[some].tolist(), first[some].tolist(), end[some].tolist()):
                    docs_of, places = seen[h, o, text[f : e + length - 1]]
                    docs_of.append(doc)
                    places.append(f)
        bucket = ranges(np.array([k[0] for k in seen], np.uint64), buckets).tolist()
        signed = np.array([k[0] for k in seen], np.uint64).view(np.int64)
        rows = [
            (b, number, int(a), k[1], k[2], np.array(d, np.uint64).tobytes(), np.array(p, np.int64).tobytes(), None, None, None)
            for b, a, (k, (d, p)) in zip(bucket, signed, seen.items())
        ]
        # By digest; equal strings have equal hashes, so each distinct one has its hash's place.
        distinct, where, often = np.unique(np.concatenate(digests), return_index=True, return_counts=True)
        hashes = np.concatenate(strings)[where]
        order = np.argsort(hashes, kind="stable")
        hashes, distinct, often = hashes[order], distinct[order], np.minimum(often[order], 2).astype(np.uint8)
        for b, s in cuts(ranges(hashes, buckets), buckets):
            rows.append((b, number, None, None, None, None, None, pack(hashes[s]), often[s].tobytes(), distinct[s].tobytes()))
        return table_of(schema, rows)

    def sort(table: pa.Table) -> pa.Table:
        spread = pc.is_valid(table.column("strings"))
        hot, table = table.filter(spread), table.filter(pc.invert(spread))
        column, numbers = table.column("context"), table.column("chunk").to_numpy()
        keys, places = table.column("docs"), table.column("places")
        first_digit = table.column("anchor").to_numpy().view(np.uint64)
        offset = table.column("offset").to_numpy()
        sizes = pc.binary_length(column).to_numpy().astype(np.int64)
        weight = pc.binary_length(places).to_numpy() // 8
        order = np.argsort(first_digit, kind="stable")
        # Runs of neighbouring strings of one context, at every place that the context stands for.
        out: dict[int, list] = defaultdict(list)
        for some in _by_anchor(first_digit[order], sizes[order]):
            some = order[some]
            data = b"".join(column[int(i)].as_py() for i in some)
            found = _repeated(data, sizes[some], first_digit[some], offset[some], weight[some], length)
            for c, a, z in zip(some[found[0]].tolist(), found[1].tolist(), found[2].tolist()):
                start = np.frombuffer(places[c].as_py(), np.int64)
                out[int(numbers[c])].append((np.frombuffer(keys[c].as_py(), np.uint64), start + a, start + z + length))
        rows = [(c, *(pack(np.concatenate([r[i] for r in runs])) for i in range(3)), None, None) for c, runs in out.items()]
        rows += [(c, None, None, None, h, d) for c, h, d in _repeated_strings(hot)]
        return table_of({"chunk": INT, "docs": BIN, "starts": BIN, "ends": BIN, "strings": BIN, "digests": BIN}, rows)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        runs: dict[int, np.ndarray] = {}
        strings, digests = np.zeros(0, np.uint64), set()
        if answers.num_rows:
            digests = {x.tobytes() for d in answers.column("digests").drop_null() for x in np.frombuffer(d.as_py(), "V16")}
            strings = np.concatenate([strings, *(unpack(x.as_py()) for x in answers.column("strings").drop_null())])
            strings.sort()
            answers = answers.filter(pc.is_valid(answers.column("docs")))
        if answers.num_rows:
            keys = np.concatenate([unpack(x.as_py()) for x in answers.column("docs")])
            both = np.stack([np.concatenate([unpack(x.as_py(), np.int64) for x in answers.column(c)]) for c in ("starts", "ends")])
            order = np.argsort(keys, kind="stable")
            keys, both = keys[order], both[:, order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            runs = dict(zip(keys[starts].tolist(), np.split(both, starts[1:], axis=1)))
        rows = []
        for key, text in _rows(table):
            found = runs.get(_doc_key(key, text)) if runs else None
            removed, spans, left = 0, 0, text
            change = np.zeros(len(text) + 1, np.int32)
            if found is not None:
                np.add.at(change, found[0], 1)
                np.add.at(change, found[1], -1)
            for at in _places(text, strings, digests, length):
                change[at] += 1
                change[at + length] -= 1
            if change.any():
                gone = np.cumsum(change)[:-1] > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((key, len(text), removed, spans, left))
        return table_of({"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept": BIN}, rows)

    known = chunks.groupBy("chunk").applyInArrow(first_digits, _ANCHORS).groupBy("bucket").applyInArrow(lambda t: _kinds(t, hot_runs), _KINDS)
    spans = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(contexts, _CONTEXTS)
    runs = spans.groupBy("bucket").applyInArrow(sort, _RUNS)
    return chunks.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(cut, _RESULT)
