"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the one the cluster names in spark.checkpoint.dir; a local session without one (tests) gets a temporary folder, any
    other session must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed, but written as Parquet, which keeps large tables of repeated values small; the folder goes with the other checkpoints."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key(doc_id: Column, text: Column) -> Column:
    """Identity of a document: equal ids with equal texts are one document, also where the id is null."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))).alias("key")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizer of the `tokenizers` library, loaded once per Python worker; strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


#: Rows of a few hundred bytes that may be broadcast.
FEW = 50_000
#: Rows of a few numbers that fill a partition.
FULL = 20_000


def if_few(df: DataFrame, most: int = FEW, rows: int | None = None) -> DataFrame:
    """A checkpointed table, marked for broadcast when it is counted, or known by `rows`, to have at most `most` rows; else joins shuffle it."""
    return F.broadcast(df) if (df.limit(most + 1).count() if rows is None else rows) <= most else df


def filled(df: DataFrame, rows: int, full: int | None = None) -> DataFrame:
    """A checkpointed table of so many rows in no more partitions than they fill; else each step over a few rows takes as many tasks,
    files and log entries as the session has shuffle partitions."""
    return df.coalesce(max(1, -(-rows // (full or FULL))))


def narrow(df: DataFrame, full: int | None = None) -> DataFrame:
    """As checkpointed, for rows of a few numbers; then in no more partitions than the rows fill."""
    df = checkpointed(df)
    return filled(df, df.count(), full)
