"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared checkpoint folder, so that a lost executor costs no stage twice.

In every stage: nulls in any column are carried, and a null text counts as an empty one; very long texts are worked on whole; repeated rows are judged alike, each for itself; an empty table gives no rows; columns
beside those of ``documents`` are carried as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelift.llm import decontamination, minhash, packing, personal, toxicity
from pagelift.llm.batches import saved, table

#: SQL cannot express the classifier, the tagger and the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is a half or more go; without labels of both kinds the score is their share. A score of exactly a half goes."""
    return toxicity.rejected_out(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles or more, the one with the least id stays. A row with a null id, and one without a word, links with nothing and stays; rows that share the least
    id all stay."""
    return minhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; so do documents of which more than half is benchmark (exactly half stays). Without benchmark items nothing goes."""
    return decontamination.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked. Of spans that overlap, the run of them becomes the name of the first kind. A null text stays null."""
    return personal.redacted(docs, personal.trained())


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences; a null or empty text is its end token alone. Only id and text are read."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("packing", into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
