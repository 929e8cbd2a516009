"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks. A block holds documents of like size as the rows of a bit
matrix whose columns are the bits of a Bloom signature, stored by column: the slice of a
signature bit is a bitmap over the block's documents. A document enters (term, step) for
every step of `STEPS` that the term's count reaches, so the slices of a term, and-ed,
overestimate which documents hold it and how often.

A search sums, for each document, the terms' weights at the counts that the slices allow:
an upper bound of its score, in whole numbers like the score. The documents of highest
bound are rescored from their texts; the k-th best of them is a score that the answer
cannot fall below. All documents whose bound reaches it are then rescored exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallymart.llm.common import LOWER, UPPER, mix, stash, text_rows
from tallymart.llm.units import WordHashes

#: Counts of a term that have bits of their own; the last but one doubles on.
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128)
#: Hash functions of a term's presence (a false one adds its whole weight to a bound), and
#: of the higher steps (a false one adds little).
HASHES, STEP_HASHES = 10, 3
#: Signature bits for an entry, before rounding up to a power of two.
ENTRY_BITS = 24
#: Limits of a signature and of a block; longer documents get fuller signatures, whose
#: bounds are wider and as valid.
_MOST_BITS = 1 << 22
_BLOCK_BYTES = 1 << 20
_BLOCK_ROWS = 1024
#: Documents of highest bound that are rescored first, for each one wanted: more of them
#: give a higher score to beat.
SEEDS = 4
#: Terms x documents that a task bounds at a time.
_CELLS = 4_000_000
#: Distinct terms that a task counts before it hands the counts on.
_HELD_TERMS = 300_000

_TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
              for c in range(256))
_INDEX = pa.schema([("kind", pa.string()), ("term", pa.string()), ("count", pa.int64()),
                    ("bits", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("sizes", pa.list_(pa.int64())), ("slices", pa.binary())])
_INDEX_DDL = ("kind string, term string, count long, bits long, doc_ids array<long>, "
              "sizes array<long>, slices binary")


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all code points beyond ASCII; only A-Z lowered."""
    return text.translate(_FOLD).split()


def places(hashes: np.ndarray, step: np.ndarray | int, bits: int, count: int) -> np.ndarray:
    """``count`` signature bits of (term, step), one row a hash function."""
    one = mix(hashes + _ODD * np.asarray(step, np.uint64))
    two = mix(one ^ _ODD) | np.uint64(1)
    return np.stack([(one + np.uint64(i) * two) & np.uint64(bits - 1) for i in range(count)])


class _Block:
    """Documents of one signature width, until they make a block."""

    def __init__(self, bits: int):
        self.bits = bits
        self.room = max(8, min(_BLOCK_ROWS, _BLOCK_BYTES * 8 // bits // 8 * 8))
        self.ids: list = []
        self.sizes: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.steps: list[np.ndarray] = []

    def add(self, doc_id: int | None, size: int, hashes: np.ndarray, steps: np.ndarray) -> bool:
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.hashes.append(hashes)
        self.steps.append(steps)
        return len(self.ids) >= self.room

    def row(self) -> dict:
        wide = (len(self.ids) + 7) // 8
        slices = np.zeros((self.bits, wide), np.uint8)
        owner = np.repeat(np.arange(len(self.ids)), [len(h) for h in self.hashes])
        hashes, steps = np.concatenate(self.hashes), np.concatenate(self.steps)
        for some, count in ((steps == 1, HASHES), (steps > 1, STEP_HASHES)):
            rows = owner[some]
            bit = (128 >> (rows & 7)).astype(np.uint8)
            for at in places(hashes[some], steps[some], self.bits, count):
                np.bitwise_or.at(slices.reshape(-1), at.astype(np.int64) * wide + (rows >> 3), bit)
        return {"kind": "block", "bits": self.bits, "doc_ids": self.ids, "sizes": self.sizes,
                "slices": slices.tobytes()}


def _entries(counts: Counter, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and step of everything that a document with these counts enters."""
    hashes = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
    often = np.fromiter(counts.values(), np.int64, len(counts))
    reached = np.searchsorted(STEPS, often, side="right")
    owner = np.repeat(np.arange(len(counts)), reached)
    first = np.repeat(np.cumsum(reached) - reached, reached)
    return hashes[owner], np.asarray(STEPS, np.uint64)[np.arange(len(owner)) - first]


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, holders, blocks = WordHashes(), Counter(), {}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    def counted() -> pa.RecordBatch:
        return batch([{"kind": "term", "term": t.decode(), "count": c} for t, c in holders.items()])

    for ids, texts in text_rows(batches):
        for doc_id, text in zip(ids, texts):
            terms = terms_of(text)
            if not terms:
                continue
            counts = Counter(terms)
            holders.update(counts.keys())
            hashes, steps = _entries(counts, known)
            bits = 1 << int(ENTRY_BITS * len(hashes) - 1).bit_length()
            bits = max(64, min(bits, _MOST_BITS))
            block = blocks.setdefault(bits, _Block(bits))
            if block.add(doc_id, len(terms), hashes, steps):
                yield batch([blocks.pop(bits).row()])
        if len(holders) >= _HELD_TERMS:
            yield counted()
            holders.clear()
        if len(known) >= _HELD_TERMS:
            known.clear()
    for bits in list(blocks):
        yield batch([blocks.pop(bits).row()])
    if holders:
        yield counted()


@dataclass
class Index:
    """Blocks of signatures, documents per term, and what the weights need."""

    blocks: DataFrame
    holders: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame) -> Index:
    """The index of all rows with at least one term; needs doc_id and text."""
    rows = docs.select("doc_id", "text").mapInArrow(_index_rows, _INDEX_DDL)
    written = stash(rows, "lexical-index")
    blocks = written.where("kind = 'block'").select("bits", "doc_ids", "sizes", "slices")
    holders = written.where("kind = 'term'").groupBy("term").agg(F.sum("count").alias("df"))
    total = blocks.agg(
        F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    return Index(blocks, holders, total[0] or 0, total[1] or 0)


@dataclass
class Queries:
    """The items of one pass: distinct terms with hashes, and each item's terms and weights."""

    terms: list[bytes]
    hashes: np.ndarray
    items: list[int]  # numbers of the items, in the order of the two below
    columns: list[np.ndarray]
    weights: list[np.ndarray]

    @classmethod
    def of(cls, rows: list) -> Queries:
        """From rows (number, terms, weights) of the items."""
        terms = sorted({t.encode() for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(terms)}
        known = WordHashes()
        return cls(terms, np.fromiter(map(known.__getitem__, terms), np.uint64, len(terms)),
                   [r["item"] for r in rows],
                   [np.array([number[t.encode()] for t in r["terms"]], np.int64) for r in rows],
                   [np.array(r["weights"], np.int64) for r in rows])


def _share(tf: np.ndarray | int, m: np.ndarray | int):
    """What a term's weight is multiplied by: grows with its count, falls with length."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _length(size: int, n_docs: int, n_terms: int) -> int:
    """A document's length in hundredths of the mean, half of it damped away."""
    return 100 - 50 + (50 * size * n_docs) // n_terms


def _parts_of(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[tuple]:
    """Blocks as (bits, doc ids, sizes, slices), cut by rows so that terms x rows stays bounded."""
    rows = max(8, _CELLS // max(1, n_terms) // 8 * 8)
    for batch in batches:
        for i in range(batch.num_rows):
            bits = batch.column("bits")[i].as_py()
            ids, sizes = batch.column("doc_ids")[i].values, batch.column("sizes")[i].values.to_pylist()
            slices = np.frombuffer(batch.column("slices")[i].as_buffer(), np.uint8).reshape(bits, -1)
            for at in range(0, len(sizes), rows):
                yield bits, ids[at:at + rows], sizes[at:at + rows], slices[:, at // 8:(at + rows) // 8]


def _bounds(queries: Queries, bits: int, sizes: list[int], slices: np.ndarray,
            n_docs: int, n_terms: int) -> Iterator[np.ndarray]:
    """For each item, no less than the score of every document of a block.

    Sums are whole numbers far below 2**53 in doubles, hence exact.
    """
    m = np.array([_length(size, n_docs, n_terms) for size in sizes], np.int64)
    sizes = np.array(sizes, np.int64)
    # A document that has not reached a step has the term one time less at most.
    most = [np.minimum(after - 1, sizes) for after in STEPS[1:]] + [sizes]
    gain = np.diff(np.stack([_share(tf, m) for tf in most]), axis=0, prepend=0).astype(np.float64)
    parts = np.zeros((len(queries.terms), len(sizes)))
    live, seen = np.arange(len(queries.terms)), None
    for k, step in enumerate(STEPS):
        at = places(queries.hashes[live], step, bits, STEP_HASHES if k else HASHES).astype(np.int64)
        held = np.bitwise_and.reduce(slices[at], axis=0)
        if seen is not None:
            held &= seen
        some = held.any(axis=1)
        live, seen = live[some], held[some]
        if not len(live):
            break
        present = np.unpackbits(seen, axis=1, count=len(sizes)).astype(bool)
        parts[live] += np.where(present, gain[k], 0.0)
    for columns, weights in zip(queries.columns, queries.weights):
        yield weights.astype(np.float64) @ parts[columns]


_CANDIDATE = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("bound", pa.int64())])
_CANDIDATE_DDL = "item long, doc_id long, bound long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    items, ids, bounds = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(items), pa.int64()), pa.concat_arrays(ids),
         pa.array(np.concatenate(bounds).astype(np.int64))], schema=_CANDIDATE)


def _highest(queries: Queries, k: int, n_docs: int, n_terms: int):
    """The k documents of highest bound of each item, over all blocks of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), pa.array([], pa.int64())) for _ in queries.items]
        for bits, ids, sizes, slices in _parts_of(batches, len(queries.terms)):
            for q, bound in enumerate(_bounds(queries, bits, sizes, slices, n_docs, n_terms)):
                had, had_ids = best[q]
                least = had.min() if len(had) >= k else 0.0
                at = np.flatnonzero(bound > least)
                if len(at) > k:
                    at = at[np.argpartition(-bound[at], k - 1)[:k]]
                if not len(at):
                    continue
                had, had_ids = np.r_[had, bound[at]], pa.concat_arrays([had_ids, ids.take(pa.array(at))])
                if len(had) > k:
                    top = np.argpartition(-had, k - 1)[:k]
                    had, had_ids = had[top], had_ids.take(pa.array(top))
                best[q] = had, had_ids
        for item, (had, had_ids) in zip(queries.items, best):
            if len(had):
                yield _batch([(np.full(len(had), item), had_ids, had)])
    return run


def _reaching(queries: Queries, least: dict[int, int], n_docs: int, n_terms: int):
    """All documents whose bound is positive and reaches the item's least score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bits, ids, sizes, slices in _parts_of(batches, len(queries.terms)):
            rows = []
            for item, bound in zip(queries.items, _bounds(queries, bits, sizes, slices, n_docs, n_terms)):
                at = np.flatnonzero(bound >= max(1, least.get(item, 1)))
                if len(at):
                    rows.append((np.full(len(at), item), ids.take(pa.array(at)), bound[at]))
            if rows:
                yield _batch(rows)
    return run


def _rescore(queries: Queries, n_docs: int, n_terms: int):
    """(item, doc_id, score) of each document and each of its ``items``, from the text."""
    place = {item: q for q, item in enumerate(queries.items)}
    weights = [dict(zip((queries.terms[c] for c in columns), w.tolist()))
               for columns, w in zip(queries.columns, queries.weights)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text, items in zip(*(batch.column(c) for c in ("doc_id", "text", "items"))):
                terms = terms_of((text.as_py() or "").encode())
                if not terms:
                    continue
                counts = Counter(terms)
                m = _length(len(terms), n_docs, n_terms)
                for item in items.as_py():
                    score = sum(w * _share(counts[t], m) for t, w in weights[place[item]].items() if t in counts)
                    if score > 0:
                        found.append((item, doc_id.as_py(), score))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*found), _SCORED)], schema=_SCORED)
    return run


_SCORED = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_SCORED_DDL = "item long, doc_id long, score long"
#: Candidate pairs that may be broadcast (some 10 to 50 bytes each); more are joined by shuffle.
_BROADCAST_PAIRS = 1_000_000


def _scored(docs: DataFrame, wanted: DataFrame, queries: Queries, index: Index) -> DataFrame:
    """Exact scores of the (item, doc_id) pairs in ``wanted``; rows that share an id all count."""
    asked = stash(wanted.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "lexical-candidates")
    few = (asked.agg(F.sum(F.size("items"))).first()[0] or 0) <= _BROADCAST_PAIRS
    asked = asked.withColumnRenamed("doc_id", "asked_id")
    texts = docs.select("doc_id", "text")
    same = texts["doc_id"].eqNullSafe(asked["asked_id"])
    joined = texts.join(F.broadcast(asked) if few else asked, same)
    return joined.select("doc_id", "text", "items").mapInArrow(
        _rescore(queries, index.n_docs, index.n_terms), _SCORED_DDL)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, index: Index | None = None,
           items_a_pass: int = 500, terms_a_pass: int = 20_000) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of every item, all if fewer.

    ``docs`` needs doc_id and text, ``items`` item_id and text. Terms are maximal runs of
    ASCII letters, digits and code points beyond ASCII, A-Z lowered, over whole texts. An
    item's score of a document sums its distinct terms' weights times a share that grows
    with the term's count there, in whole numbers; documents with score 0 are not ranked.
    Equal scores fall by ascending doc_id, a null id last. Null, empty and term-less texts
    (of either side) match nothing; repeated rows and repeated ids are ranked each on its
    own, repeated items each give a full answer. Other columns are left alone. Empty
    tables give no rows.

    Items pass in blocks of at most ``items_a_pass`` items and about ``terms_a_pass``
    terms, so what travels to the tasks is bounded; each pass reads the index, and the
    texts of its candidates alone are scored again.
    """
    index = build_index(docs) if index is None else index
    asked = _weighted(items, index, items_a_pass, terms_a_pass)
    passes = [r["pass"] for r in asked.select("pass").distinct().orderBy("pass").collect()]
    answers = None
    for number in passes:
        rows = asked.where(F.col("pass") == number).select("item", "terms", "weights").collect()
        queries = Queries.of(rows)
        sizes = index.n_docs, index.n_terms
        first = index.blocks.mapInArrow(_highest(queries, SEEDS * k, *sizes), _CANDIDATE_DDL)
        top = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
        first = first.withColumn("place", F.row_number().over(top)).where(F.col("place") <= SEEDS * k)
        sure = _ranked(_scored(docs, first.select("item", "doc_id"), queries, index), k)
        least = {r["item"]: r["score"] for r in sure.where(F.col("rank") == k).collect()}
        reach = index.blocks.mapInArrow(_reaching(queries, least, *sizes), _CANDIDATE_DDL)
        found = _ranked(_scored(docs, reach.select("item", "doc_id"), queries, index), k)
        found = stash(found, "lexical-answers")
        answers = found if answers is None else answers.unionByName(found)
    named = asked.select("item", "item_id")
    if answers is None:
        answers = docs.sparkSession.createDataFrame([], _SCORED_DDL + ", rank int")
    return answers.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _weighted(items: DataFrame, index: Index, items_a_pass: int, terms_a_pass: int) -> DataFrame:
    """item (a number for each row), item_id, terms, weights and pass of every item with terms.

    Terms that no document holds are left out: they add nothing to any score.
    """
    numbered = stash(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"),
                     "lexical-items")
    distinct = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(_TERM), F.lit(1)))
    held = numbered.select("item", "item_id", F.explode(distinct).alias("term")).join(index.holders, "term")
    ratio = F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weight = F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long")
    packed = stash(held.groupBy("item", "item_id").agg(F.sort_array(F.collect_list(
        F.struct("term", weight.alias("weight")))).alias("pairs")), "lexical-queries")
    n_items, n_terms = packed.agg(F.count(F.lit(1)), F.sum(F.size("pairs"))).first()
    passes = max(1, -(-n_items // items_a_pass), -(-(n_terms or 0) // terms_a_pass))
    return packed.select("item", "item_id", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights"),
                         F.pmod(F.xxhash64("item"), F.lit(passes)).alias("pass"))


#: The query over documents and benchmark, with 50 documents an item.
SEARCH_SQL = """
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, '{upper}', '{lower}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms
  FROM documents),
sized AS (SELECT row, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
counted AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY row, term),
weighted AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE)))
                    AS BIGINT) AS w
  FROM counted, totals GROUP BY term),
asked AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(
    translate(text, '{upper}', '{lower}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
scored AS (
  SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // totals.terms)))) AS BIGINT)
         AS score
  FROM asked JOIN weighted USING (term) JOIN counted USING (term) JOIN sized USING (row), totals
  GROUP BY item, row)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
WHERE rank <= 50
"""
