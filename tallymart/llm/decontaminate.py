"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size. For a partition whose items have at most u
shingles, every document is seen as overlapping windows of 2u shingles, u apart, so
that a window holds each passage of u shingles whole and the containment asked for
becomes a Jaccard similarity of at least a fifth, however long the document. An item
is a candidate for a document if any of 64 min-hashes agrees in any window; the
chance to miss a passage is then below one in a million. An item of at most eight
shingles is too small for a window and looked up exactly: of u shingles, c of which
have to be there, some u - c + 1 are looked for, one of which must be. Candidates are
checked by the exact share of the item's shingles that the whole document contains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import LOWER, UPPER, digest, mix, runs_between, stash, text_rows, whole_texts

HASHES = 64
SHINGLE = 5
CONTAINMENT = 0.8
#: Items looked for in one pass over the documents; their hashes take about 20 MB.
ITEMS_A_PASS = 20_000
BYTES_A_PASS = 20_000_000
#: Words whose hashes a task remembers between batches; they take about 13 MB.
WORDS_KNOWN = 100_000
#: Bytes of text that a task looks through at once; words and min-hashes take some 30 times that.
TEXT_AT_ONCE = 1_000_000
_EXACT = 8  # items of up to so many shingles are looked up exactly
_SMALLEST = 16  # the first partition has items of up to so many shingles; each next twice as many

# ASCII letters are lower-cased, ASCII punctuation and control characters part words.
_PARTS = bytes(range(33)) + bytes(c for c in range(33, 128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(UPPER.encode() + _PARTS, LOWER.encode() + b" " * len(_PARTS))

_RANDOM = np.random.default_rng(8)
_TIMES = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64)
# What is least begins with zeros: times this, its first bits tell values apart as well as its last.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_WORD_TIMES = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def shingles_of(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """Word shingles joined by a space; fewer words than a shingle are one, none are none."""
    return [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class _WordHashes(dict):
    """A 64-bit hash per word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all full shingles of hashed words."""
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = total * _WORD_TIMES[k] + words[k:n + k]
    return mix(total)


def _hashes(words: list[bytes], known: _WordHashes) -> np.ndarray:
    found = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(found) >= SHINGLE or not len(found):
        return _shingle_hashes(found) if len(found) else found
    # A short text has one shingle of all its words; its length keeps it apart from longer ones.
    total = np.full(1, len(found), np.uint64)
    for w in found:
        total = total * _WORD_TIMES[0] + w
    return mix(total)


class ItemIndex:
    """Test items by size partition, with the min-hashes and shingles of each."""

    def __init__(self, items: list[tuple], containment: float):
        known = _WordHashes()
        self.containment = containment
        self.shingles: dict[object, frozenset[bytes]] = {}
        self.partitions: dict[int, tuple[list, np.ndarray]] = {}
        self.short: dict[int, list] = {}  # items of fewer words than a shingle, by their hash
        self.few: dict[int, list] = {}  # items of up to _EXACT shingles, by hashes one of which must be there
        sized: dict[int, list] = {}
        for item_id, text in items:
            words = words_of(text.encode())
            if not words:
                continue
            self.shingles[item_id] = frozenset(shingles_of(words))
            hashes = np.unique(_hashes(words, known))
            if len(words) < SHINGLE:
                self.short.setdefault(int(hashes[0]), []).append((item_id, len(words)))
                continue
            if len(hashes) <= _EXACT:
                needed = int(np.ceil(containment * len(hashes) - 1e-9))
                for h in hashes[:len(hashes) - needed + 1].tolist():
                    self.few.setdefault(h, []).append(item_id)
                continue
            size = _SMALLEST
            while size < len(hashes):
                size *= 2
            sized.setdefault(size, []).append((item_id, (hashes[:, None] * _TIMES + _PLUS).min(axis=0)))
        for size, rows in sized.items():
            self.partitions[size] = ([r[0] for r in rows], np.stack([r[1] for r in rows]) * _SPREAD)
        self.sizes = sorted(self.partitions)
        self.few_hashes = np.array(sorted(self.few), np.uint64)
        # Per hash function a small table of the items' values rules most windows out at once.
        self.tables = {}
        for size, (_, mins) in self.partitions.items():
            bits = min(16, 4 + len(mins).bit_length())  # room for 16 times the values or more
            shift = np.uint64(64 - bits)
            maybe = np.zeros((HASHES, 1 << bits), bool)
            for j in range(HASHES):
                maybe[j, mins[:, j] >> shift] = True
            places = [np.argsort(mins[:, j], kind="stable") for j in range(HASHES)]
            self.tables[size] = maybe, shift, places, [mins[p, j] for j, p in enumerate(places)]
        self.short_sizes = sorted({n for rows in self.short.values() for _, n in rows})

    def candidates(self, hashes: list[np.ndarray]) -> set[tuple[int, object]]:
        """(number of the text, item) pairs for texts given by their shingle hashes."""
        sizes = np.array([len(h) for h in hashes])
        found: set[tuple[int, object]] = set()
        if not sizes.sum():
            return found
        if self.few:
            joined, ends = np.concatenate(hashes), np.cumsum(sizes)
            near = np.searchsorted(self.few_hashes, joined).clip(max=len(self.few_hashes) - 1)
            for at in np.flatnonzero(self.few_hashes[near] == joined):
                text = int(np.searchsorted(ends, at, side="right"))
                found |= {(text, item) for item in self.few[int(joined[at])]}
        if not self.sizes:
            return found
        step = self.sizes[0]
        blocks = -(-sizes // step)
        owner = np.repeat(np.arange(len(sizes)), blocks)  # the text of each block
        place = runs_between(np.zeros(len(sizes), np.int64), blocks)
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + place * step
        joined = np.concatenate(hashes)
        mins = np.empty((HASHES, len(starts)), np.uint64)
        for j in range(HASHES):
            mins[j] = np.minimum.reduceat(joined * _TIMES[j] + _PLUS[j], starts)
        for size in self.sizes:
            while step < size:  # blocks of twice the length, from pairs of blocks
                even = np.flatnonzero(place % 2 == 0)
                mins = self._with_next(mins, owner)[:, even]
                owner, place, step = owner[even], place[even] // 2, step * 2
            # Two neighbouring blocks are a window; what is least in it is so in a block.
            window = self._with_next(mins, owner) * _SPREAD
            maybe, shift, places, values = self.tables[size]
            items = self.partitions[size][0]
            for j in range(HASHES):
                kept = np.flatnonzero(maybe[j][window[j] >> shift])
                first = np.searchsorted(values[j], window[j, kept])
                n = np.searchsorted(values[j], window[j, kept], side="right") - first
                texts = np.repeat(owner[kept], n)
                same = places[j][runs_between(first, n)]
                found.update((text, items[i]) for text, i in set(zip(texts.tolist(), same.tolist())))
        return found

    @staticmethod
    def _with_next(mins: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The smaller of each block's values and those of the next block of its text."""
        out = mins.copy()
        same = np.flatnonzero(owner[1:] == owner[:-1])
        out[:, same] = np.minimum(mins[:, same], mins[:, same + 1])
        return out

    def short_items(self, words: list[bytes], known: _WordHashes) -> set:
        """Items of fewer words than a shingle that stand in the text as they are."""
        return {item for n in self.short_sizes for i in range(len(words) - n + 1)
                for item, _ in self.short.get(int(_hashes(words[i:i + n], known)[0]), ())}


def _search(index: ItemIndex):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for ids, texts in text_rows(batches, TEXT_AT_ONCE):
            if len(known) > WORDS_KNOWN:
                known = _WordHashes()
            words = [words_of(t) for t in texts]
            none = np.zeros(0, np.uint64)
            found = index.candidates([_hashes(w, known) if len(w) >= SHINGLE else none for w in words])
            if index.short:
                found |= {(k, item) for k, w in enumerate(words) for item in index.short_items(w, known)}
            rows, sets = [], {}
            for k, item in sorted(found):
                wanted = index.shingles[item]
                size = next(iter(wanted)).count(b" ") + 1
                if (k, size) not in sets:
                    sets = {(k, size): {b" ".join(words[k][i:i + size])
                                        for i in range(len(words[k]) - size + 1)}}
                shared = len(wanted & sets[k, size])
                if shared + 1e-9 >= index.containment * len(wanted):
                    rows.append((ids[k], item, shared, len(wanted), hashlib.md5(texts[k]).digest()))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)),
                 pa.array([r[4] for r in rows], pa.binary())],
                ["doc_id", "item_id", "n_shared", "n_shingles", "digest"])
    return search


def _leaks(docs: DataFrame, items: DataFrame, containment: float, items_a_pass: int) -> DataFrame:
    """What ``contaminated`` gives, with the MD5 of each text."""
    texts = whole_texts(docs)
    known = items.where("text IS NOT NULL").select("item_id", "text")
    n_items, n_bytes = known.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-n_items // items_a_pass), -(-(n_bytes or 0) // BYTES_A_PASS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    found = None
    for k in range(passes):
        held = known.where(part == k).collect()
        byid = {n: (r["item_id"], r["text"]) for n, r in enumerate(held)}
        index = ItemIndex([(n, text) for n, (_, text) in byid.items()], containment)
        names = docs.sparkSession.createDataFrame(
            [(n, i) for n, (i, _) in byid.items()], "_n long, _item long")
        hits = texts.mapInArrow(
            _search(index), "doc_id long, item_id long, n_shared long, n_shingles long, digest binary")
        rows = hits.join(F.broadcast(names), hits["item_id"] == names["_n"]).select(
            "doc_id", F.col("_item").alias("item_id"), "n_shared", "n_shingles",
            (F.col("n_shared") / F.col("n_shingles")).alias("containment"), "digest")
        if passes > 1:  # written before the next pass's items are fetched
            rows = stash(rows, "leaks")
        found = rows if found is None else found.unionByName(rows)
    return found


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT,
                 items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every leaked item.

    A row says that the whole text of doc_id has at least ``containment`` of the item's
    distinct word shingles. ASCII case and punctuation do not count. An item without a
    word (or a null text) leaks nowhere; one of under five words has them as its only
    shingle. Items of equal id are looked up separately and give rows of their own. Items
    are sent to the tasks ``items_a_pass`` or about ``BYTES_A_PASS`` at a time: what a pass
    holds is bounded, and more items mean more passes over the documents. A null or empty
    document holds no item; equal documents give equal rows, null doc_ids theirs. Empty
    tables give no rows; other columns are not used.
    """
    return _leaks(docs, items, containment, items_a_pass).drop("digest")


def without_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item.

    A row goes for its own text: one without an id too, and a clean row that shares its
    doc_id with a leaked one stays.
    """
    leaks = _leaks(docs, items, containment, ITEMS_A_PASS).select(
        F.col("doc_id").alias("l_id"), F.col("digest").alias("l_text")).distinct()
    text = digest(F.coalesce("text", F.lit("")))
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("l_id")) & (text == F.col("l_text")), "left_anti")


LEAK_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), {fold}) AS t FROM documents
  UNION ALL
  SELECT 'i', item_id, translate(coalesce(text, ''), {fold}) FROM benchmark),
lists AS (
  SELECT kind, id, list_filter(string_split(t, ' '), lambda w: w <> '') AS w FROM words),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM lists WHERE len(w) > 0)),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'i')
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(i.n) AS n_shingles,
       count(*) / any_value(i.n) AS containment
FROM shingles d JOIN items i USING (s) WHERE d.kind = 'd'
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(i.n)
"""
