"""What several of the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymart.session import new_scratch_path, stash  # noqa: F401  (used by the operators)

# The white space and the letters that the contracts name.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def id_ranges(docs: DataFrame, parts: int) -> list[tuple]:
    """Up to ``parts`` half-open doc_id ranges of about equal row counts, ascending.

    The first has no lower bound and takes rows without an id, the last has no
    upper one: every row is in exactly one range.
    """
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(found or []))
    return list(zip([None, *cuts], [*cuts, None]))


def in_range(bounds: tuple, column: str = "doc_id") -> Column:
    low, high = bounds
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col(column) >= low)
    if high is not None:
        inside = inside & (F.col(column) < high)
    return F.coalesce(inside, F.lit(False)) if low is not None else F.coalesce(inside, F.lit(True))


def text_rows(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """(doc ids, texts as UTF-8 bytes) in runs of about ``most`` bytes, whole texts each."""
    ids, texts, held = [], [], 0
    for batch in batches:
        column = batch.column("text").cast(pa.binary())
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), column):
            text = text.as_py() or b""
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if held >= most:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def small_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts have about ``most`` bytes, one text at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finishing steps of a well-known 64-bit mixer)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def runs_between(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one after the other."""
    total = int(lengths.sum())
    steps = np.ones(total, np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    if total:
        at = np.r_[0, np.cumsum(lengths)[:-1]]
        steps[at] = np.r_[starts[0], starts[1:] - starts[:-1] - lengths[:-1] + 1]
    return np.cumsum(steps)
