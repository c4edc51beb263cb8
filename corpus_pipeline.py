"""The corpus pipeline over `documents`: rejected documents go, repeated lines go,
one document of each group of near copies stays, contaminated documents go, and
what is left is packed.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
`docs`; the last returns a row for each packed piece. Empty tables give empty
results; what each stage does with nulls, empty and very long texts, ties and
repeated rows is stated where its operator is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from origo.llm import decontam, jaccard, lines, packing, quality
from origo.llm.catalog import tokenizer
from origo.llm.common import checkpointed, ship, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    ship(spark)
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.filter("predicted = 1").select(*docs.columns)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines, and without lines of two words or more,
    that occur earlier; `n_chars` follows."""
    kept = lines.dedup(docs, alone=2).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at 0.8 connect."""
    ship(spark)
    return jaccard.dedup(docs, 0.8, 5)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window similar to a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), 0.8, 5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer(), 1024)


STAGES = [
    ("quality", reject_low_quality),
    ("line_dedup", delete_repeated_lines),
    ("jaccard_dedup", keep_one_of_near_copies),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]

# A fitted classifier and a genetic algorithm are beyond SQL; the stages are
# tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
