"""Documents in units that ask about their keys and are answered.

Operators over every word or byte of the corpus would drown in one row a position.
Here documents lie in units of some megabytes (one bucketed table, written once, so
that no later step shuffles a text again). A unit sends each of its *different* keys
once, packed by key range; a group per key range merges what all units sent and
answers every unit in the order it asked. However often a key occurs, a unit sends
it once, so a hot key costs no more than one entry a unit.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymart.session import new_scratch_path, shuffles_removed, stash

#: The least size of a unit and of what one key range answers for.
UNIT_BYTES = 8_000_000
#: Text behind one message, a unit's keys of one range. Units and ranges of s bytes each
#: make (size / s) ** 2 messages, so s is the root of size times this: messages then grow
#: in proportion to the text, and units with its root (8 MB up to 10 GB, 100 MB at 2 TB,
#: 700 MB at 100 TB, which executors of that size hold).
MESSAGE_BYTES = 5_000
#: Text of one bucket of the unit table, which one task reads.
BUCKET_BYTES = 128_000_000
#: unit, which question, key range, and packed columns.
MESSAGE = "unit long, step int, range long, a binary, b binary, c binary"
_MESSAGE = pa.schema([("unit", pa.int64()), ("step", pa.int32()), ("range", pa.int64()),
                      ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def unit_size(size: int, least: int = UNIT_BYTES) -> int:
    """Bytes of a unit, and of a key range, for so many bytes of text."""
    return max(least, math.isqrt(size * MESSAGE_BYTES))


class Units:
    """A document table dealt into units row by row.

    Neither rows without an id nor repeated rows share a unit, so a unit stays near
    ``unit_bytes`` whatever the ids are. Rows are told apart by their place in ``docs``,
    which should be a written table, so that a repeated task deals them alike.
    """

    def __init__(self, docs: DataFrame, unit_bytes: int = UNIT_BYTES):
        spark = docs.sparkSession
        texts = self.columns(docs)
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count = max(64, -(-size // unit_size(size, unit_bytes)))
        self.ranges = max(64, -(-size // unit_size(size)))
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        partitions = min(self.count, max(shuffled, -(-size // BUCKET_BYTES)))
        name = f"text_units_{uuid.uuid4().hex}"
        writer = texts.withColumn("unit", self.unit_of()).repartition(partitions, "unit").write.option(
            "path", new_scratch_path(spark, "units")).option("compression", "zstd").bucketBy(
            partitions, "unit").sortBy("unit")
        with shuffles_removed(spark):
            writer.saveAsTable(name)
        self.table = spark.table(name)

    def columns(self, docs: DataFrame) -> DataFrame:
        empty = F.lit("").cast(docs.schema["text"].dataType)
        return docs.select("doc_id", F.coalesce(F.col("text"), empty).alias("text"))

    def unit_of(self):
        return F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(self.count))

    def with_ids(self, ids: DataFrame) -> DataFrame:
        """doc_id and unit: every unit that holds rows of the (distinct) ids."""
        return self.table.select("doc_id", "unit").distinct().join(ids, "doc_id")

    def run(self, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
            answers: list[DataFrame]) -> DataFrame:
        """``work`` on the documents and all answers of every unit."""
        rows = self.table.groupBy("unit")
        if not answers:
            return rows.applyInArrow(lambda docs: work(docs, _MESSAGE.empty_table()), schema)
        told = answers[0]
        for more in answers[1:]:
            told = told.unionByName(more)
        return rows.cogroup(told.groupBy("unit")).applyInArrow(work, schema)

    def ask(self, work: Callable[[pa.Table, pa.Table], pa.Table], answers: list[DataFrame],
            reply: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
        """The answers to what ``work`` asks, written."""
        asked = self.run(work, MESSAGE, answers)
        return stash(asked.groupBy("range").applyInPandas(reply, MESSAGE), "answers")


def message_rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _MESSAGE)],
                    schema=_MESSAGE)


def cut_by_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal parts of the 64-bit space starts in sorted keys."""
    edges = np.array([((k << 64) + ranges - 1) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def answer(table: pa.Table, step: int, column: str = "a") -> bytes | None:
    """What came back for a step, joined in the order of the key ranges; None if unasked."""
    steps = table.column("step").to_numpy()
    ranges = table.column("range").to_numpy()
    rows = np.flatnonzero(steps == step)
    if not len(rows):
        return None
    cells = table.column(column)
    return b"".join(cells[int(i)].as_py() for i in rows[np.argsort(ranges[rows], kind="stable")])


def pack48(keys: np.ndarray) -> bytes:
    """The upper six bytes of every key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.reshape(-1).view("<u8")


class WordHashes(dict):
    """A 64-bit hash for every word, remembered for the words of a unit."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def hashed_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words end."""
    known = WordHashes()
    parts = []
    for text in texts:
        words = text.as_py().encode().split()  # bytes.split knows exactly the six ASCII spaces
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), ends
