"""Spelling variants: words one edit apart, by dense tiles of common prefixes and suffixes.

Two words differ by one inserted, deleted or replaced code point exactly if their common
prefix and common suffix together reach the longer one's length less one. Where the edit
stands (the length of the common prefix) lies in an interval of places, and all words
that could meet there share the prefix before the interval and the suffix after it. Words
are grouped by both, for the lower and the upper half of the places; a group larger than
a tile is halved again. At a single place only the letters of the alphabet are left, so
groups end small whatever the vocabulary. In tiles of padded code-point matrices every
block meets every block at or after it, and a pair counts in the one group whose interval
has its place, so none counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallymart.llm.common import LOWER, UPPER, stash

#: Words a group may have before it is halved, and words of a tile.
GROUP_WORDS = 256
TILE_WORDS = 128
_TILE_CELLS = 4_000_000
_RUN = "[A-Za-z\\u00C0-\\u00FF]+"


def vocabulary(docs: DataFrame, run: str = _RUN, spoil: int = 97, least_length: int = 5,
               least_count: int = 3) -> DataFrame:
    """word and n: the distinct words of all texts, with how often they occur.

    A word is a maximal run of the pattern's letters, A-Z lowered. One in ``spoil`` pairs
    of document and word (by crc32 of `<doc_id>:<word>`) loses the code point that the
    hash names. A null doc_id hashes as empty text; a null text has no words.
    """
    lowered = F.translate("text", UPPER, LOWER)
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                        F.explode(F.regexp_extract_all(lowered, F.lit(f"({run})"), F.lit(1))).alias("run"))
    hashed = words.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    length = F.char_length("run")
    at = F.pmod("h", length).cast("int")
    spoiled = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
    word = F.when(F.col("h") % spoil == 0, spoiled).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy(
        "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _halves(words: DataFrame) -> DataFrame:
    """Each word once for every half interval of places that it could be edited in.

    ``longer`` is the length of the longer word of a pair, so a word of length l stands
    for pairs with longer = l and longer = l + 1. Places run from 0 to longer - 1; an
    insertion at the end counts as the last place.
    """
    length = F.char_length("word")
    wide = words.select("*", F.explode(F.array(length, length + 1)).alias("longer"))
    return _cut(wide.withColumns({"low": F.lit(0), "high": F.col("longer") - 1}))


def _cut(rows: DataFrame) -> DataFrame:
    """Both halves of each row's interval, with the hash of what their words share."""
    middle = F.floor((F.col("low") + F.col("high") + 1) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), (middle - 1).alias("high")),
                     F.struct(middle.alias("low"), F.col("high").alias("high")))
    split = rows.select("word", "n", "longer", F.explode(halves).alias("h")).select(
        "word", "n", "longer", "h.low", "h.high")
    return split.withColumn("key", _shared())


def _shared() -> Column:
    """Hash of the prefix before the interval and the suffix after it."""
    after = F.col("longer") - 1 - F.col("high")
    suffix = F.when(after > 0, F.substring("word", -after, after)).otherwise("")
    return F.xxhash64(F.substring("word", F.lit(1), F.col("low")), suffix)


_GROUP = ["longer", "low", "high", "key"]


def groups(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word and n in every group that it has to be compared in; the groups are small.

    A group ends with ``group_words`` words at most, or at a single place of edit. Groups
    of one word are gone.
    """
    # A number instead of its four parts: groups of different kinds meet with one chance
    # in 2**64, and then only add comparisons that find nothing.
    rows = stash(_halves(words), "edit-halves")
    done = []
    while True:
        sizes = stash(rows.groupBy(_GROUP).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "edit-groups")
        large = (F.col("size") > group_words) & (F.col("low") < F.col("high"))
        done.append(rows.join(sizes.where(~large).select(_GROUP), _GROUP, "left_semi"))
        if sizes.where(large).limit(1).count() == 0:
            break
        rows = stash(_cut(rows.join(sizes.where(large).select(_GROUP), _GROUP, "left_semi")), "edit-halves")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def padded(words: list[str], width: int, right: bool = False) -> np.ndarray:
    """Code points of the words, one row each, zeros after them (or before them)."""
    out = np.zeros((len(words), width), np.uint32)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    column = np.arange(width)
    out[(column >= width - sizes[:, None]) if right else (column < sizes[:, None])] = points
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns each row of ``a`` has in common with each row of ``b``."""
    differ = np.ones((len(a), len(b), a.shape[1] + 1), bool)
    np.not_equal(a[:, None, :], b[None, :, :], out=differ[:, :, :-1])
    return differ.argmax(axis=2)


def near_in_tile(words: list[str], group: np.ndarray, longer: np.ndarray, low: np.ndarray,
                 high: np.ndarray, others: slice, own: slice) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i in ``own`` and j in ``others`` after it, that count in their group."""
    a, b = words[own], words[others]
    width = max(map(len, a + b))
    prefix = common(padded(a, width), padded(b, width))
    suffix = common(padded(a, width, True)[:, ::-1], padded(b, width, True)[:, ::-1])
    i, j = np.arange(own.start, own.stop), np.arange(others.start, others.stop)
    sizes_a, sizes_b = (np.fromiter(map(len, w), np.int64, len(w)) for w in (a, b))
    larger = np.maximum(sizes_a[:, None], sizes_b)
    last = larger - 1
    place = np.minimum(prefix, last)
    hit = ((group[i][:, None] == group[j]) & (i[:, None] < j) & (larger == longer[i][:, None])
           & (prefix + suffix >= last) & (place >= low[i][:, None]) & (place <= high[i][:, None]))
    x, y = np.nonzero(hit)
    return i[x], j[y]


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by group: how many near words each has in it, and the best of them."""
    held = None
    for batch in _with_end(batches):
        table = batch if held is None or batch is None else pa.concat_tables([held, batch])
        if batch is None:
            table, held = held, None
        if table is None or not table.num_rows:
            continue
        parts = [table.column(c).to_numpy() for c in _GROUP]
        change = np.ones(table.num_rows, bool)
        change[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in parts])
        starts = np.flatnonzero(change)
        if batch is not None:  # the last group may go on
            held = table.slice(starts[-1])
            table, starts = table.slice(0, starts[-1]), starts[:-1]
        if table.num_rows:
            yield from _compare(table, starts)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    for batch in batches:
        yield pa.Table.from_batches([batch])
    yield None


def _compare(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = table.column("word").to_pylist()
    n, longer, low, high = (table.column(c).to_numpy() for c in ("n", "longer", "low", "high"))
    group = np.zeros(len(words), np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    ends = np.r_[starts[1:], len(words)]
    widest = max(map(len, words)) + 1
    size = max(1, min(TILE_WORDS, int((_TILE_CELLS / widest) ** 0.5)))
    left, right = [], []
    for at in range(0, len(words), size):
        own = slice(at, min(at + size, len(words)))
        for to in range(at, int(ends[group[own.stop - 1]]), size):  # as far as its last group goes
            others = slice(to, min(to + size, len(words)))
            i, j = near_in_tile(words, group, longer, low, high, others, own)
            left.append(i)
            right.append(j)
    i, j = np.concatenate(left + right), np.concatenate(right + left)
    if not len(i):
        return
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array([w.encode() for w in words], object), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[j], -n[j], i))  # the best of each word first
    i, j = i[order], j[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    count = np.diff(np.r_[first, len(i)])
    yield pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in i[first]]), pa.array(count, pa.int64()),
         pa.array([words[k] for k in j[first]]), pa.array(n[j[first]], pa.int64())],
        ["word", "n_near", "near", "near_n"])


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, n_near, near and near_n: each word with a near word, and its best one."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups(words, group_words).repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)
    found = dealt.mapInArrow(_near_rows, "word string, n_near long, near string, near_n long")
    # The least of (-n, word): largest n first, then the smallest word (text compares by
    # UTF-8 bytes, which is code-point order).
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form, by doubling the way each has gone.

    A form occurs at least twice as often as its word, so no way is longer than the
    binary logarithm of the largest count, and no way comes back.
    """
    at = stash(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(at.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots")
        if moved.where("moved").limit(1).count() == 0:
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_groups(docs: DataFrame, group_words: int = GROUP_WORDS, **words: object) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the vocabulary.

    Needs doc_id and text; ``words`` goes to ``vocabulary``. A word's form is its near
    word of largest n (of equals the smallest in code-point order) if that occurs at
    least twice as often, else null; root is the last of the chain of forms, the word
    itself without one. Repeated rows count as often as they occur, null and empty texts
    have no words, very long words are compared whole. Other columns are left alone. An
    empty table gives no rows.
    """
    vocab = stash(vocabulary(docs, **words), "vocabulary")
    near = near_words(vocab, group_words)
    known = vocab.join(near, "word", "left")
    takes = F.col("near_n") >= 2 * F.col("n")
    known = stash(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
