"""A training corpus from the documents table: five stages, each written and read again by the next.

Defined cases: a null text counts as empty in every stage, and of all empty texts one row stays, the one with the
smallest id; it is packed as its end mark. Rows without an id take part in toxicity, exact dedup and
decontamination, are never near copies, and stay beside rows that have ids only if no equal text has one. Repeated
rows become one. Rows that share an id but not their text are judged each for itself; of near copies the smallest
id stays. Without usable labels nothing is toxic; without benchmark items nothing is contaminated; an empty table
gives an empty result. Further columns, whatever their names, come through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandlens.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from demandlens.llm.catalog import END_ID, toxicity_model, vocabulary
from demandlens.llm.common import read_table
from demandlens.session import stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return toxicity.drop_toxic(docs, toxicity_model(docs, read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, the one with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays: five words a shingle, 0.8."""
    return jaccard_join.keep_first(docs, words=5, percent=80)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length."""
    return packing.pack(docs, vocabulary(), END_ID)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("exact dedup", exact),
    ("ngram jaccard join", near),
    ("benchmark decontamination", unseen),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result staged as Parquet for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
