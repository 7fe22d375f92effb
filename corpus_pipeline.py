"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All stages but the last keep the columns of documents. SQL cannot express tokenisers and fingerprints, so there is no oracle
statement; tests compare every stage with a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import linededup, mixing, neardup, packing, rules
from tideline.llm.common import shared_folder

#: Target weights of the mixture by domain, language and source; other names weigh 1.
WEIGHTS = mixing.WEIGHTS
#: The mixture's tokens as a percentage of what the stage is given, and the most times that a source is repeated.
PERCENT, EPOCHS = 100, 2
#: Words of a shingle, and the Jaccard similarity from which on two documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.keep_sound(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents stay in the first document only; n_chars follows the text."""
    kept = linededup.drop_recurring_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: those whose sets of five-word shingles are similar to 0.8 are linked.

    Candidates are sets whose SimHashes differ in two bits or fewer; as such few bits cannot stand for that similarity, also those that meet in
    bands of least hashes. All are verified."""
    return neardup.keep_one_similar(docs, SHINGLE, SIMILARITY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights, from seeded epochs."""
    return mixing.mixed_documents(docs, weights=WEIGHTS, percent=PERCENT, epochs=EPOCHS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixture), ("packing", packed)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows over the documents of `sf_dir`; what each stage leaves is written to `folder`, which executors must share and which
    the caller may delete when the rows have been used, or else to a new one beside the session's checkpoints."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
