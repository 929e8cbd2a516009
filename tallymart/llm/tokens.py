"""Token ids as binary segments with Elias-Fano document boundaries.

A written folder holds two Parquet tables. ``segments``: one row per run of
consecutive documents with their ids concatenated as little-endian unsigned
integers (16 bits if the vocabulary allows, else 32), the document numbers, and
the boundaries as an Elias-Fano code: the low bits of each offset packed, the
high bits in unary, and every 64th one of these at a sampled place, so that a
select finds any offset by looking at a few bytes. ``places``: where each segment
starts among all ids.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallymart.llm.common import runs_between, small_batches

SEGMENT_IDS = 250_000
#: Text that a task encodes at a time; each different word in it is looked up once.
PIECE_BYTES = 6_000_000
_SAMPLE = 64
_KEPT = "_kept_between_tasks_of_a_worker"  # name of a module that is no file


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(last / n) bits each."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, width
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        last = int(values[-1]) if n else 0
        width = max(0, (last // n).bit_length() - 1) if n else 0
        shifts = np.arange(width, dtype=np.int64)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8), bitorder="little")
        ones = (values >> width) + np.arange(n)
        bits = np.zeros((int(ones[-1]) if n else 0) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, width, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(),
                   ones[::_SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        start = i * self.width
        chunk = self.low[start // 8:(start + self.width + 7) // 8]
        return (int.from_bytes(chunk, "little") >> (start % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // _SAMPLE])
        wanted, byte = i % _SAMPLE, at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= wanted:
            wanted -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(wanted):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return ((place - i) << self.width) | self._low(i)

    def values(self) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        upper = np.flatnonzero(bits)[:self.n] - np.arange(self.n)
        flat = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.width,
                             bitorder="little").reshape(self.n, self.width).astype(np.int64)
        return (upper << self.width) + (flat << np.arange(self.width, dtype=np.int64)).sum(axis=1)


# A plain space with other white space beside it, or at an end: no place to cut.
_ODD_SPACE = r"[\s\x1C-\x1F\x{85}\p{Z}] | [\s\x1C-\x1F\x{85}\p{Z}]|^ | $"
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


class WordwiseEncoder:
    """Ids of a byte-level tokenizer, each different word encoded once a piece.

    The split pattern of such tokenizers never joins the two sides of a space that
    stands between two other characters, so a text can be cut before each such
    space. Words not seen before are encoded together, and their ids told apart by
    the tokens that start with the space. The first ``most_words`` words, which the
    frequent ones are among, are remembered; what comes later is encoded in each piece.
    """

    def __init__(self, path: str, most_words: int = 300_000):
        # One thread a task: a pool of threads in every worker costs memory and shares no work.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_words = most_words
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.length = np.zeros(0, np.int64)

    @classmethod
    def of_worker(cls, path: str) -> WordwiseEncoder:
        """The encoder that earlier tasks of this worker process have filled, or a new one."""
        kept = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _encode_words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, all their ids, and how many each has.

        A word with a space inside is encoded on its own.
        """
        plain = [w for w in words if " " not in w]
        odd = [w for w in words if " " in w]
        parts = [" " + " ".join(plain[i:i + 500]) for i in range(0, len(plain), 500)]
        found = self._whole(parts + [" " + w for w in odd])
        joined = np.concatenate(found[:len(parts)] or [np.zeros(0, np.uint32)])
        opening = np.flatnonzero(self.opens[joined])
        if len(opening) != len(plain):
            raise ValueError("the tokenizer joins words across a space")
        ids = np.concatenate([joined, *found[len(parts):]])
        length = np.append(np.diff(np.append(opening, len(joined))),
                           [len(x) for x in found[len(parts):]]).astype(np.int64)
        return plain + odd, ids, length

    def _numbered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A number for each word, and by number the ids (one after the other) and their counts."""
        known = self.number
        at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        fresh = np.flatnonzero(at < 0)
        all_ids, all_lengths = [self.ids], [self.length]
        seen = len(self.length)
        for i in range(0, len(fresh), 20_000):
            some = [words[k] for k in fresh[i:i + 20_000]]
            order, ids, length = self._encode_words(some)
            number = dict(zip(order, range(seen, seen + len(order))))
            at[fresh[i:i + 20_000]] = [number[w] for w in some]
            seen += len(order)
            all_ids.append(ids)
            all_lengths.append(length)
            if len(known) < self.most_words and seen == len(known) + len(order):
                known.update(number)
                self.ids, self.length = np.concatenate([self.ids, ids]), np.concatenate([self.length, length])
        return at, np.concatenate(all_ids), np.concatenate(all_lengths)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        words = pc.split_pattern(texts, " ")
        other = pc.match_substring_regex(texts, _ODD_SPACE)
        for token in self.special:  # a text with a special token's string is not cut
            other = pc.or_(other, pc.match_substring(texts, token))
        if not pc.any(other).as_py():
            return words
        return pa.array([w.as_py() if not o else
                         [t] if any(s in t for s in self.special) else _BETWEEN_WORDS.split(t)
                         for w, o, t in zip(words, other.to_pylist(), texts.to_pylist())],
                        pa.list_(pa.string()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids end."""
        cut = self._cut(texts)
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        # The first word of a text has no space before it: its ids come from a second list.
        heads = self._whole([words[i] for i in which[first]])
        at, ids, lengths = self._numbered(words)
        begins = np.cumsum(lengths) - lengths
        length, begin = lengths[at][which], begins[at][which]
        length[first] = [len(h) for h in heads]
        begin[first] = len(ids) + np.cumsum(length[first]) - length[first]
        ends = np.cumsum(length)
        every = np.concatenate([ids, *heads])
        return every[runs_between(begin, length)], ends[np.append(first[1:], len(which)) - 1]


_FIELDS = pa.schema([
    ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
    ("width", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.binary()), ("low_bits", pa.int32()),
    ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
_SCHEMA = ("part long, seq long, n_docs long, n_ids long, width int, ids binary, doc_ids binary, "
           "low_bits int, low binary, high binary, samples binary")
_NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id


def _segment(part: int, seq: int, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray,
             width: int) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    code = EliasFano.encode(ends)
    row = (part, seq, len(sizes), int(ends[-1]), width, ids.astype(f"<u{width}").tobytes(),
           doc_ids.astype("<i8").tobytes(), code.width, code.low, code.high, code.samples)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FIELDS)],
                                      schema=_FIELDS)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The batches cut or joined to pieces of about ``most`` bytes of text, one text at least."""
    held, size = [], 0
    for batch in small_batches(batches, most):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0,
                 order_by: str = "doc_id", segment_ids: int = SEGMENT_IDS,
                 piece_bytes: int = PIECE_BYTES) -> None:
    """Encode every text, append ``end_id``, and write the documents in ``order_by`` order.

    A null text is empty, a very long one is encoded whole. Nulls in ``order_by`` come
    first, ties in any order that is the same for ids and boundaries; repeated rows are
    documents of their own. An empty table writes empty tables. Other columns are not
    written, and may have any name. ``tokenizer`` is a file that every executor can read.
    A task encodes ``piece_bytes`` of text at a time; less takes less memory and more time.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordwiseEncoder.of_worker(tokenizer)
        width = 2 if max(len(encoder.opens) - 1, end_id) < 1 << 16 else 4
        part, seq, held = TaskContext.get().partitionId(), 0, []
        for piece in _pieces(batches, piece_bytes):
            ids, ends = encoder.encode(piece.column("text").chunk(0))
            numbers = piece.column("doc_id").fill_null(_NO_ID).to_numpy()
            held.append((numbers, np.insert(ids, ends, end_id).astype(f"u{width}"),
                         np.diff(ends, prepend=0) + 1))
            del ids, ends, piece
            pa.default_memory_pool().release_unused()
            numbers, ids, sizes = (np.concatenate(c) for c in zip(*held))
            reached = np.append(0, np.cumsum(sizes))
            start = 0
            while reached[-1] - reached[start] >= segment_ids:
                stop = int(np.searchsorted(reached, reached[start] + segment_ids))
                yield _segment(part, seq, numbers[start:stop], ids[reached[start]:reached[stop]],
                               sizes[start:stop], width)
                start, seq = stop, seq + 1
            held = [(numbers[start:], ids[reached[start]:], sizes[start:])]
        if held and len(held[0][2]):
            yield _segment(part, seq, *held[0], width)

    order = F.col(order_by)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), order.alias("_order"), F.xxhash64(text).alias("_tie"))
    # Rows without a key, or of one key, are split by what they say.
    ordered = keyed.repartitionByRange("_order", "_tie").sortWithinPartitions("_order", "_tie", "doc_id")
    ordered.select("doc_id", "text").mapInArrow(encode, _SCHEMA).write.option(
        "compression", "none").parquet(f"{folder}/segments")
    spark = docs.sparkSession
    sizes = spark.read.schema(_SCHEMA).parquet(f"{folder}/segments").select("part", "seq", "n_ids")
    # Segments before one in its task, and tasks before its task.
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    sizes.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(
        tasks, "part").select(
        "part", "seq", (F.col("_before") + F.col("_inside")).alias("first_id")).write.parquet(
        f"{folder}/places")


_DOC_FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()),
    ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            code = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
            ends = np.fromiter(map(code.select, range(code.n)), np.int64, code.n)
            starts = np.append(0, ends[:-1])
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
            numbers = np.frombuffer(row["doc_ids"], "<i8")
            n = len(ends)
            yield pa.RecordBatch.from_arrays([
                pa.array(numbers, mask=numbers == _NO_ID), pa.array(np.full(n, row["part"])),
                pa.array(np.full(n, row["seq"])), pa.array(starts), pa.array(ends - starts),
                pa.array(sums, pa.int64())], schema=_DOC_FIELDS)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    rows = spark.read.schema(_SCHEMA).parquet(f"{folder}/segments").mapInArrow(
        _documents, "doc_id long, part long, seq long, offset long, n_tokens long, ids_crc32 long")
    places = spark.read.schema("part long, seq long, first_id long").parquet(f"{folder}/places")
    return rows.join(places, ["part", "seq"]).select(
        "doc_id", (F.col("first_id") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
