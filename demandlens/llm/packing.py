"""Sequences for training without padding: every document is cut into pieces of power-of-two length.

A document of n tokens gives one piece for each power of two that n is made of, the longest pieces
first and none longer than ``max_length``. Pieces of one length form a bucket, a piece is a sequence
of its own, so no sequence crosses documents and none is padded. No shuffle is needed.

Defined cases: a null or empty text is a document of one token, the end mark. Repeated rows are packed
each; an empty table gives no piece. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import texts

MAX_LENGTH = 4096
#: Words whose ids a worker keeps.
WORDS = 500_000
#: Stands between words that are looked up together.
MARK = "\x01"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Words of characters that no normalizer changes but by case: printable ASCII and Latin-1 letters.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]{1,1000}").fullmatch
#: ``WORD_SPLIT`` on such words in lower case, with a line break behind each.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+|\n").findall
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end of a word's piece, as the vocabulary's suffix does.
END = "\x02"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to ``n``, in falling order."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def _merged(parts: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    while len(parts) > 1:
        first, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if first == len(rank):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def has_plain_words(path: str) -> bool:
    """Whether ``PlainWords`` gives the ids of this tokenizer file.

    It merges by tokens, the file by pairs. That is the same if the ids follow the merges and each merge's token is
    what its own characters are merged to: then no other pair of tokens that spells it can come to stand together.
    """
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, suffix = described["model"], "</w>"
    normal, split = described.get("normalizer") or {}, described.get("pre_tokenizer") or {}
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    parts = [(n["type"], n.get("pattern"), n.get("behavior"), n.get("invert"), n.get("add_prefix_space"), n.get("use_regex")) for n in split.get("pretokenizers", [])]
    known = (
        model.get("type") == "BPE" and model.get("end_of_word_suffix") == suffix
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and described.get("post_processor") is None
        and steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and parts == [("Split", {"Regex": WORD_SPLIT}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        # Such a token in a text is looked for before anything else.
        and all(x["special"] for x in described["added_tokens"])
    )
    if not known:
        return False
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {pair: i for i, pair in enumerate(merges)}
    ids = [model["vocab"].get("".join(pair), -1) for pair in merges]
    single = [i for t, i in model["vocab"].items() if len(t.removesuffix(suffix)) == 1]
    if len(single) != 512 or any(a >= b for a, b in zip([max(single), *ids], ids)):
        return False
    for token in map("".join, merges):
        spelt = list(token.removesuffix(suffix))
        if token.endswith(suffix):
            spelt[-1] += suffix
        if len(_merged(spelt, rank)) > 1:
            return False
    return True


class PlainWords:
    """Ids of plain words by the vocabulary's bytes alone, several times as fast as the tokenizer."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        # Printable bytes stand for themselves, the others for code points from 256 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = sorted(set(range(256)) - set(own))
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
        special = [x["content"] for x in described["added_tokens"]]
        ranks = {}
        for token, i in described["model"]["vocab"].items():
            if token not in special:
                spelt = bytes(map(byte_of.__getitem__, token.removesuffix("</w>")))
                ranks[spelt + END.encode() if token.endswith("</w>") else spelt] = i
        self.encoding = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n" + END.encode()]
        self.special = special

    def takes(self, word: str) -> bool:
        return PLAIN(word) is not None and not any(x in word for x in self.special)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids behind each other, and how many each has."""
        pieces = SPLIT("\n".join([*words, ""]).lower())
        ids = np.array(self.encoding.encode_ordinary(END.join([*pieces, ""])), "<u4")
        ends = np.flatnonzero(ids == self.line)
        return ids[ids != self.line], np.diff(ends, prepend=-1) - 1


class WordIds(dict):
    """Token ids of texts, each distinct word looked up once; what is kept is bounded.

    Splitting at ASCII white space first gives the tokenizer's own ids if it drops white space and
    handles what lies between on its own, as word vocabularies do. ``plain`` says that the file is one
    that ``has_plain_words``.
    """

    def __init__(self, path: str, limit: int = WORDS, plain: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.mark = self.encode([MARK])[0]
        self.plain = PlainWords(path) if plain else None
        self.forget()

    def encode(self, batch: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.start, self.size, self.pool = array("q"), array("q"), array("I")

    def __missing__(self, word: bytes) -> int:
        """Numbers a new word; its ids follow with ``learn``."""
        self.new.append(word)
        place = self[word] = len(self)
        return place

    def tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words at a time with a mark between them, as each call has a price."""
        if len(self.mark) == 1 and not any(MARK in w for w in words):
            ids = np.array(self.encode([f" {MARK} ".join(words)])[0], "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            if len(ends) != len(words):
                raise ValueError("the tokenizer does not handle words on their own")
            return ids[ids != self.mark[0]], np.diff(ends, prepend=-1) - 1
        each = self.encode(words)
        return np.array([i for found in each for i in found], "<u4"), np.array([len(found) for found in each], np.int64)

    def learn(self) -> None:
        for at in range(0, len(self.new), 20_000):
            words = [w.decode("utf-8", "replace") for w in self.new[at : at + 20_000]]
            plain = np.array([self.plain is not None and self.plain.takes(w) for w in words])
            start, size = np.zeros((2, len(words)), np.int64)
            for ids_of, places in ((self.plain, np.flatnonzero(plain)), (self.tokenized, np.flatnonzero(~plain))):
                if len(places):
                    ids, n = ids_of([words[i] for i in places.tolist()])
                    start[places], size[places] = len(self.pool) + np.cumsum(n) - n, n
                    self.pool.frombytes(ids.tobytes())
            self.start.extend(start.tolist())
            self.size.extend(size.tolist())
        self.new = []

    def of(self, documents: list[bytes]) -> Iterator[np.ndarray]:
        if len(self) > self.limit:
            self.forget()
        places = []
        for text in documents:
            words = text.split()
            places.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        self.learn()
        start, size, pool = np.array(self.start), np.array(self.size), np.array(self.pool, "<u4")
        for at in places:
            n = size[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            yield pool[np.repeat(start[at] - ends + n, n) + np.arange(total)]


@functools.lru_cache(1)
def _coder(path: str, plain: bool) -> WordIds:
    """One for each worker process, whose words serve all its tasks."""
    return WordIds(path, plain=plain)


def pack(docs: DataFrame, tokenizer: str, end_id: int, max_length: int = MAX_LENGTH) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ids are little-endian 32-bit numbers.

    ``max_length`` is a power of two. ``tokenizer`` is a file that the driver and every executor can read.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    plain = has_plain_words(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = _coder(tokenizer, plain)
        end = np.array([end_id], "<u4")
        for batch in batches:
            # Slices of bounded text, however long the rows are.
            for rows in _slices(batch):
                keys = [r[0] for r in rows]
                out: list[tuple] = []
                for key, ids in zip(keys, coder.of([r[1] for r in rows])):
                    ids = np.concatenate([ids, end])
                    at = 0
                    for length in binary_lengths(len(ids), max_length):
                        out.append((key, at, length, ids[at : at + length].tobytes(), len(ids)))
                        at += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    pieces = texts(docs).mapInArrow(run, PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def _slices(batch: pa.RecordBatch, limit: int = 2_000_000) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        value = text.as_py()
        rows.append((key, value))
        size += len(value)
        if size >= limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader takes sequences of one length at a time."""
    pieces.write.partitionBy("length").parquet(path)
