"""Best-fit packing of documents into sequences of a fixed number of tokens, in bounded space.

Documents are tokenised where they are read, one text at a time; only (document, piece, length) rows travel further. Each packing task takes
a fixed number of pieces as they arrive, in an order of hashes that says nothing of their lengths and is the same after a retry, and holds a
fixed number of open sequences in a bitset keyed by free space: a piece goes to the open sequence with the least sufficient space, and
when a new one is needed and all are open, the fullest closes. A task emits each piece as it places it, so it holds the open
sequences' numbers and nothing else.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import checkpointed, load, vocabulary
from tideline.llm.wordcache import id_cache, ids_of

END = np.array([1], "<u4").tobytes()
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(text: str | None, path: str, size: int) -> Iterator[bytes]:
    """The document's ids and the end id, as unsigned 32-bit bytes, in pieces of `size` ids."""
    held = bytearray()
    for part in ids_of(text or "", id_cache(path)):
        held += part
        while len(held) >= 4 * size:
            yield bytes(held[: 4 * size])
            del held[: 4 * size]
    yield bytes(held) + END


def pieces(docs: DataFrame, size: int = 4096, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `size` tokens: doc_id, piece, start, length, ids_crc32, and with keep_ids the ids."""
    place = path or vocabulary("word_bpe_49k.json")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if keep_ids else [])]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]

    def run(batches):
        for batch in batches:
            columns = [[] for _ in kinds]
            # a batch's texts stay in Arrow's memory; one at a time becomes a string
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for n, data in enumerate(cut(text.as_py(), place, size)):
                    row = doc_id, n, n * size, len(data) // 4, zlib.crc32(data), np.frombuffer(data, "<u4").astype("i4")
                    for column, value in zip(columns, row, strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + ", ids array<int>" * keep_ids)


class BestFit:
    """Online best fit with at most `bins` open sequences of `size` tokens."""

    def __init__(self, size: int, bins: int, numbers: Iterator[int]):
        self.size, self.bins, self.numbers = size, bins, numbers
        self.bits, self.open, self.at = 0, 0, defaultdict(list)  # at[free] holds the sequences with that much space

    def _take(self, free: int) -> int:
        found = self.at[free].pop()
        self.open -= 1
        if not self.at[free]:
            self.bits ^= 1 << free
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of the next piece."""
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.bins and length < self.size:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.size, next(self.numbers)
        if left := free - length:
            if not self.at[left]:
                self.bits |= 1 << left
            self.at[left].append(number)
            self.open += 1
        return number, self.size - free


#: Open sequences of a task. Thousands more would save about half a per cent of the sequences.
BINS = 64


def pack(found: DataFrame, size: int = 4096, bins: int = BINS, per_task: int = 16384) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to `size`; about `per_task` rows go to each task."""
    found = checkpointed(found)
    tasks = max(1, -(-found.count() // per_task))

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        packer = BestFit(size, bins, count(first))
        for pdf in batches:
            placed = [packer.place(n) for n in pdf.length.tolist()]
            yield pdf.assign(sequence_id=pd.Series([x[0] for x in placed], dtype="int64"), offset=pd.Series([x[1] for x in placed], dtype="int64"))

    order = [F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return found.repartition(tasks).sortWithinPartitions(*order).mapInPandas(run, schema)


def pack_documents(docs: DataFrame, size: int = 4096, bins: int = BINS, per_task: int = 16384, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, with keep_ids).

    Needs doc_id and text; other columns are not read. Null and empty texts are the end id alone; null ids and repeated rows are
    packed like others. A document longer than `size` is cut into whole pieces and a rest. An empty table gives no rows.
    """
    return pack(pieces(docs, size, path, keep_ids), size, bins, per_task)


def fill(packed: DataFrame, size: int = 4096) -> DataFrame:
    """One row: pieces, tokens, sequences, the fewest sequences that could hold the tokens, and their share of the sequences used."""
    each = packed.groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"))
    total = each.agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count("*").alias("sequences"))
    return total.withColumn("least", F.ceil(F.col("tokens") / size)).withColumn("fill", F.col("least") / F.col("sequences"))


def op6(spark, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
