"""Toxicity: a linear classifier over character n-grams whose features are scaled by log-count ratios.

Features say which n-grams of 3 to 5 bytes (A-Z in lower case) a text has, hashed to ``2 ** BITS`` numbers.
A feature's ratio is log((p + s) / |p + s|) - log((q + s) / |q + s|), where p and q count the toxic and the
other labelled texts that have it: the naive Bayes weight. Features whose ratio is at least ``LEAST_RATIO``
in size and whose toxic texts are ``LEAST_FAR`` standard deviations from chance stay, the farthest
``FEATURES`` of them; logistic regression
over features of value ratio gives the weights.

The fit uses at most ``SAMPLE`` labelled rows, the ones whose ids hash lowest (a documented bound: ids and
labels of the sample are broadcast, 16 bytes each). Counts over them are put together map-side in slices;
the sparse rows of the fit go to one task, and the model, at most ``FEATURES`` numbers, is broadcast. Every
text is then scored as a whole where it is read; the documents are never shuffled.

Defined cases: a null text is empty and gets the model's base score; labels that are null, conflicting, or
without a document are not learned from; repeated labels count once; repeated documents are scored each.
Without labelled rows of both kinds all scores are the share of toxic ones among them, or 0. An empty
table gives an empty result. Only ``doc_id, text`` and ``doc_id, toxic`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import distinct, pack, texts, unpack
from demandlens.session import stage

SAMPLE = 16_000
SIZES = (3, 4, 5)
BITS = 20
FEATURES, LEAST_RATIO, LEAST_FAR, SMOOTHING = 20_000, 1.0, 4.0, 0.5
#: Of the logistic regression: full passes, step, and the weight decay.
PASSES, STEP, DECAY = 300, 0.5, 1e-4
#: Counts travel in so many slices.
SLICES = 64
#: Bytes of text that are looked at together.
PART = 1_000_000


def feature_numbers(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, the number of the n-gram that starts at each byte."""
    wide = data.astype(np.uint64)
    code = np.zeros(len(data), np.uint64)
    for size in range(1, max(SIZES) + 1):
        if len(data) < size:
            return
        code = code[: len(data) - size + 1] << np.uint64(8) | wide[size - 1 :]
        if size in SIZES:
            number = (code + np.uint64(size << 56)) * np.uint64(0x9E3779B97F4A7C15)
            number ^= number >> np.uint64(29)
            yield size, (number * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes) -> np.ndarray:
    """Distinct features of a text, in order; the blank around it counts as context."""
    data = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    seen = np.zeros(1 << BITS, bool)
    for begin in range(0, len(data), PART):
        for _, numbers in feature_numbers(data[begin : begin + PART + max(SIZES) - 1]):
            seen[numbers] = True
    return np.flatnonzero(seen)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [c.to_pylist() if c.type != pa.binary() else c for c in batch.columns]
        for row in zip(*columns):
            yield tuple(v.as_py() if isinstance(v, pa.Scalar) else v for v in row)


def counts(labelled: DataFrame) -> DataFrame:
    """``slice, sums``: for each feature the texts of either kind that have it; ``labelled`` is ``text, toxic``."""
    size = (1 << BITS) // SLICES

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for text, toxic in _documents(batches):
            sums[toxic, features(text)] += 1
        rows = [(i, pack(np.ascontiguousarray(sums[:, i * size : (i + 1) * size]).reshape(-1))) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], names=["slice", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(x.as_py(), np.int64) for x in table.column("sums"))
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "sums": pa.array([pack(total)])})

    return labelled.mapInArrow(local, "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary")


def log_count_ratios(sums: np.ndarray, texts_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept features and their ratios, from counts of other and of toxic texts with each; ``texts_of``: of all."""
    q, p = sums + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # How far the toxic texts that have a feature are from chance, in standard deviations.
    have = sums.sum(axis=0)
    chance = have * texts_of[1] / max(1, texts_of.sum())
    far = np.abs(sums[1] - chance) / np.sqrt(chance + 0.5)
    kept = np.flatnonzero((np.abs(ratio) >= LEAST_RATIO) & (far >= LEAST_FAR))
    if len(kept) > FEATURES:
        kept = np.sort(kept[np.argsort(-far[kept], kind="stable")[:FEATURES]])
    return kept, ratio[kept]


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights and bias by full passes with steps scaled by each weight's past gradients."""
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    past, past_b = np.full(n, 1e-8), 1e-8
    for _ in range(PASSES):
        z = np.bincount(rows, values * w[columns], len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gradient = np.bincount(columns, values * error[rows], n) + DECAY * w
        past += gradient**2
        w -= STEP * gradient / np.sqrt(past)
        past_b += error.sum() ** 2
        b -= STEP * 0.1 * error.sum() / np.sqrt(past_b)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A weight for each feature number (0 for most), and the bias."""
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .filter("toxic = other")
        .select("doc_id", "toxic")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")
    labelled = stage(found.select("text", "toxic"), "labelled")
    sums = np.zeros((2, 1 << BITS), np.int64)
    size = (1 << BITS) // SLICES
    for number, data in counts(labelled).collect():
        sums[:, number * size : (number + 1) * size] = unpack(bytes(data), np.int64).reshape(2, -1)
    weights = np.zeros(1 << BITS, np.float32)
    of_kind = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    kept, ratio = log_count_ratios(sums, np.array([of_kind.get(0, 0), of_kind.get(1, 0)]))
    model = spark.sparkContext.broadcast((kept, ratio))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen_features = model.value[0]
        for batch in batches:
            rows = [
                (toxic, np.searchsorted(chosen_features, np.intersect1d(features(t), chosen_features, assume_unique=True)).astype(np.int32).tobytes())
                for t, toxic in _documents(iter([batch]))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["toxic", "found"])

    def train(table: pa.Table) -> pa.Table:
        kept_features, values = model.value
        y = table.column("toxic").to_numpy().astype(float)
        each = [np.frombuffer(x.as_py(), np.int32) for x in table.column("found")]
        rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
        columns = np.concatenate([*each, np.zeros(0, np.int32)])
        if 0 < y.mean() < 1:
            w, b = logistic(rows, columns, values[columns], y, len(kept_features))
        else:
            w, b = np.zeros(len(kept_features)), 40.0 * (2 * y.mean() - 1)
        return pa.table({"weights": pa.array([(w * values).tobytes()]), "bias": pa.array([float(b)])})

    rows = labelled.mapInArrow(sparse, "toxic int, found binary").withColumn("all", F.lit(0))
    trained = rows.groupBy("all").applyInArrow(lambda t: train(t), "weights binary, bias double").collect()
    if not trained:
        return weights, -40.0
    weights[kept] = np.frombuffer(bytes(trained[0][0]), np.float64)
    return weights, trained[0][1]


def _score(text: bytes, weights: np.ndarray, bias: float) -> float:
    data = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    hits = [np.zeros(0, np.int64)]
    for begin in range(0, len(data), PART):
        for _, numbers in feature_numbers(data[begin : begin + PART + max(SIZES) - 1]):
            hits.append(distinct(numbers[weights[numbers] != 0]))
    z = float(weights[distinct(np.concatenate(hits))].sum(dtype=np.float64)) + bias
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_score(t.as_py(), *sent.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], limit: float = 0.5) -> DataFrame:
    """The rows that score below ``limit``, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_score(t.as_py(), *sent.value) for t in batch], pa.float64())

    return docs.filter(score(F.coalesce(F.col("text"), F.lit("")).cast("binary")) < limit)
