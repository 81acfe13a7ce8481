"""Words that differ by one code point, and for each the frequent form that it is a misspelling of.

The vocabulary (distinct words with their counts) is numbered in code-point order. Then, with the pairs of trie
nodes as the dictionary:

1. A word's prefixes are nodes of a forward trie, its suffixes nodes of a reversed one. A node of up to
   ``SHALLOW`` letters is numbered by its letters as digits (letters are 1 to 90, so each node has its own
   number); a deeper one continues with a mixed 63-bit number below zero.
2. Each word posts the pair (prefix node, suffix node) around every letter that it could skip, and around every
   gap at which a letter could be inserted. Words that meet at one pair are neighbours: skip and skip differ by
   one replaced letter, skip and gap by one inserted or deleted letter. Of equal letters in a row only the first
   is skipped against gaps, so no neighbour is met twice.
3. Where a node of the pair is deep, two nodes may share a number; there the words themselves are fetched, by a
   join, and only equal remainders count. So the neighbours are exact.

A pair is met by at most one word a letter (90) and one gap, so no group grows with the data, and what leaves it
is one row for each of its words: how many neighbours, and the best of them. Forms are followed to their roots by
doubling; a form has at least twice its word's count, so there are few rounds.

Defined cases: null and empty texts have no words; a null id counts as empty in ``ids`` of occurrences; repeated
rows count each; an empty table gives an empty result. A word of a million letters posts two million pairs of
integers, never its substrings. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.session import stage

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One occurrence in so many loses a letter, by its hash.
DAMAGED = 97
#: A form's count is at least so many times its word's.
RATIO = 2
#: Depth to which a node's letters fit its number: 91 ** 9 < 2 ** 63.
SHALLOW, LETTERS = 9, 91

_POSTED = "p long, s long, id long, n long, at int, skip boolean, first boolean"
_NEAR = "id long, n_near long, best_n long, best_id long"


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all texts, some damaged by the hash of document and word."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("key", F.translate("run", upper, upper.lower()).alias("run")).withColumn("length", F.length("run"))
    low = low.filter(F.col("length") >= least_letters)
    h = low.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.col("length")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("length")))
    word = F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run")).alias("word")
    kept = h.select(word).filter(F.length("word") >= least_letters)
    return kept.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _letter(c: str) -> int:
    """1 to 26 for a to z, 27 to 90 for U+00C0 to U+00FF."""
    at = ord(c)
    return at - 96 if at < 0xC0 else at - 0xC0 + 27


def nodes(letters: list[int]) -> list[int]:
    """The numbers of the trie nodes that a word passes, from the root on."""
    at, out = 0, [0]
    for letter in letters[:SHALLOW]:
        at = at * LETTERS + letter
        out.append(at)
    for letter in letters[SHALLOW:]:
        at = ((at ^ (letter * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        at = ((at ^ (at >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        at ^= at >> 29
        out.append(-(at >> 1) - 1)
    return out


def postings(vocabulary: DataFrame) -> DataFrame:
    """``p, s, id, n, at, skip, first`` of every letter and gap of every word; rows leave in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"p": pa.int64(), "s": pa.int64(), "id": pa.int64(), "n": pa.int64(), "at": pa.int32(), "skip": pa.bool_(), "first": pa.bool_()}
        columns: dict[str, list] = {k: [] for k in kinds}

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], names=list(kinds))
            for held in columns.values():
                held.clear()
            return out

        def post(p: list, s: list, key: int, n: int, skip: bool, first: list) -> None:
            size = len(p)
            for name, values in zip(kinds, (p, s, [key] * size, [n] * size, range(size), [skip] * size, first)):
                columns[name].extend(values)

        for batch in batches:
            for key, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                letters = [_letter(c) for c in word]
                size = len(letters)
                forward, back = nodes(letters), nodes(letters[::-1])[::-1]
                first = [i == 0 or letters[i] != letters[i - 1] for i in range(size)]
                for at in range(0, size + 1, 50_000):
                    end = min(at + 50_000, size)
                    gap = min(at + 50_000, size + 1)
                    if at == 0:
                        post(forward[:end], back[1 : end + 1], key, n, True, first[:end])
                        post(forward[:gap], back[:gap], key, n, False, [False] * gap)
                    else:
                        before = len(columns["at"])
                        post(forward[at:end], back[at + 1 : end + 1], key, n, True, first[at:end])
                        post(forward[at:gap], back[at:gap], key, n, False, [False] * (gap - at))
                        columns["at"][before:] = [*range(at, end), *range(at, gap)]
                    if len(columns["p"]) > 50_000:
                        yield take()
        if columns["p"]:
            yield take()

    return vocabulary.select("id", "word", "n").mapInArrow(run, _POSTED)


def _meet(skips: list[tuple], gaps: list[tuple], out: dict[str, list]) -> None:
    """Adds what each word of one pair of nodes has there: neighbours, and the best by count, then by number.

    Entries are (-n, id, first).
    """
    skips.sort()
    # Words at gaps have all their letters here, so there is one unless rows are repeated.
    single = [x for x in skips if x[2]]
    for n, key, first in skips:
        others = len(skips) - 1 + (len(gaps) if first else 0)
        best = [x for x in (skips[0] if skips[0][1] != key else skips[1] if len(skips) > 1 else None, gaps[0] if first and gaps else None) if x]
        if others:
            _put(out, key, others, min(best))
    for _, key, _ in gaps:
        if single:
            _put(out, key, len(single), single[0])


def _put(out: dict[str, list], key: int, others: int, best: tuple) -> None:
    out["id"].append(key)
    out["n_near"].append(others)
    out["best_n"].append(-best[0])
    out["best_id"].append(best[1])


def _near(groups: DataFrame, verify: bool) -> DataFrame:
    """``id, n_near, best_n, best_id`` for each group of entries; with ``verify`` words' remainders are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"id": [], "n_near": [], "best_n": [], "best_id": []}
            lists = batch.column(0)
            flat = lists.flatten()
            entries = list(zip(*(flat.field(i).to_pylist() for i in range(flat.type.num_fields))))
            ends = pc.list_value_length(lists).to_numpy().cumsum()
            at = 0
            for end in ends.tolist():
                together: dict = {}
                for key, n, place, skip, first, *word in entries[at:end]:
                    rest = (place, word[0][:place] + word[0][place + skip :]) if verify else None
                    together.setdefault(rest, ([], []))[0 if skip else 1].append((-n, key, first))
                at = end
                for skips, gaps in together.values():
                    _meet(skips, gaps, out)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return groups.select("entries").mapInArrow(run, _NEAR)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``id, n_near, best_n, best_id`` of the words of a staged ``id, word, n`` that have a neighbour."""
    fields = ("id", "n", "at", "skip", "first")
    met = postings(vocabulary).groupBy("p", "s").agg(F.collect_list(F.struct(*fields)).alias("entries"))
    met = stage(met.filter(F.size("entries") > 1).filter("exists(entries, x -> x.skip)"), "node-pairs")
    deep = F.least("p", "s") < 0
    sure = _near(met.filter(~deep), False)
    told = met.filter(deep).select("p", "s", F.explode("entries").alias("e")).select("p", "s", "e.*").join(vocabulary.select("id", "word"), "id")
    checked = _near(told.groupBy("p", "s").agg(F.collect_list(F.struct(*fields, "word")).alias("entries")), True)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_id").alias("id")))
    return sure.unionByName(checked).groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "id", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.id").alias("best_id")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` from ``id, form``: the last of the forms that follow each other, by doubling."""
    at = stage(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        moved = stage(at.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), "beyond"), "roots")
        at = moved.select("id", "root")
        if moved.filter("beyond IS NOT NULL").isEmpty():
            return at


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    counted = words(docs, least_letters, least_count)
    # The numbers rise with the words, so the smaller number is the smaller word.
    vocabulary = stage(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = stage(neighbours(vocabulary), "near")
    forms = near.join(vocabulary.select("id", "n"), "id").filter(F.col("best_n") >= ratio * F.col("n")).select("id", F.col("best_id").alias("form"))
    forms = stage(forms, "forms")
    ends = forms.join(roots(forms), "id")
    names = vocabulary.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    last = vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    ends = ends.join(names, "form").join(last, "root").select("id", "form_word", "form_n", "root_word")
    out = vocabulary.join(near.select("id", "n_near"), "id", "left").join(ends, "id", "left")
    return out.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.col("form_word").alias("form"),
        "form_n",
        F.coalesce("root_word", "word").alias("root"),
    )
