"""LM scoring by cross-entropy difference of two bigram models.

The target model is counted over the target documents, the background model over
all documents; both have the same order, the same smoothing and one vocabulary, all
words of the corpus. With additive smoothing the loss of a word w after v is

    log(c(v) + a V) - log(c(v, w) + a),

a sum of a part that only needs the pair's count and one that only needs its first
word's, so that pairs and first words are counted as keys of one kind and no table of
pairs is ever joined with one of words. V, the number of different words, comes out of
the same exchange: each word is a key too, one that nobody needs an answer for. A document's score is its mean loss per
word under the target model less that under the background model: the lower, the
more it looks like the target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import mix
from tallymart.llm.units import (
    Units, answer, cut_by_range, hashed_words, message_rows, pack48, unpack48)
from tallymart.session import stash

SMOOTHING = 0.1
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x51A27)  # stands before the first word
_TARGETS, _KEYS, _SIZE, _WORDS = 0, 1, 2, 3
_RESULT = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def _keys(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word's pair and of the word before it; first words have an even key."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    starts = np.append(0, ends[:-1])
    before[starts[starts < ends]] = _START
    even, odd = np.uint64((1 << 64) - (1 << 17)), np.uint64(1 << 16)
    pairs = (mix(mix(before) * _TIMES + words) & even) | odd
    return pairs, mix(before + _TIMES) & even


def _target_mask(docs: pa.Table, told: pa.Table) -> np.ndarray:
    wanted = np.frombuffer(answer(told, _TARGETS) or b"", "<i8")
    return np.isin(docs.column("doc_id").fill_null(-1).to_numpy(), wanted) & ~np.asarray(
        docs.column("doc_id").is_null())


def _ask(ranges: int):
    def ask(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not len(docs):
            return message_rows([])
        unit = docs.column("unit")[0].as_py()
        words, ends = hashed_words(docs.column("text"))
        keys = np.concatenate(_keys(words, ends))
        target = np.tile(np.repeat(_target_mask(docs, told), np.diff(np.append(0, ends))), 2)
        different, which = np.unique(keys, return_inverse=True)
        both = np.bincount(which, minlength=len(different)).astype("<u4")
        own = np.bincount(which[target], minlength=len(different)).astype("<u4")
        cuts = cut_by_range(different, ranges)
        rows = [
            (unit, _KEYS, k, pack48(different[i:j]), own[i:j].tobytes(), both[i:j].tobytes())
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        vocabulary = np.unique(mix(words) >> np.uint64(16)) << np.uint64(16)
        cuts = cut_by_range(vocabulary, ranges)
        rows += [(unit, _WORDS, k, pack48(vocabulary[i:j]), b"", b"")
                 for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        return message_rows(rows)
    return ask


def _reply(group: pd.DataFrame) -> pd.DataFrame:
    """The corpus counts of every key asked for; one more row counts the range's different words."""
    listed = group[group["step"] == _WORDS]
    group = group[group["step"] == _KEYS]
    words = len(np.unique(np.concatenate([unpack48(a) for a in listed["a"]]))) if len(listed) else 0
    size = pd.DataFrame([(-1, _SIZE, words, b"", b"", b"")], columns=group.columns)
    if not len(group):
        return size
    parts = [unpack48(a) for a in group["a"]]
    different, which = np.unique(np.concatenate(parts), return_inverse=True)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    out = {}
    for column in ("b", "c"):
        counts = np.zeros(len(different), np.uint64)
        np.add.at(counts, which, np.frombuffer(b"".join(group[column]), "<u4").astype(np.uint64))
        out[column] = [x.tobytes() for x in np.split(counts.astype("<u8")[which], cuts)]
    return pd.concat([group.assign(a=b"", **out), size])


def _score(size: int, smoothing: float):
    def score(docs: pa.Table, told: pa.Table) -> pa.Table:
        words, ends = hashed_words(docs.column("text"))
        pairs, firsts = _keys(words, ends)
        different, which = np.unique(np.concatenate([pairs, firsts]), return_inverse=True)
        sizes = np.diff(np.append(0, ends))
        losses = []
        for column in ("b", "c"):
            counts = np.frombuffer(answer(told, _KEYS, column) or b"", "<u8").astype(np.float64)
            part = counts[which]
            loss = np.log(part[len(words):] + smoothing * size) - np.log(part[:len(words)] + smoothing)
            total = np.append(0.0, np.cumsum(loss))
            with np.errstate(invalid="ignore", divide="ignore"):
                losses.append((total[ends] - total[ends - sizes]) / sizes)
        empty = sizes == 0
        columns = [docs.column("doc_id").combine_chunks(), pa.array(sizes, pa.int64())]
        columns += [pa.array(x, mask=empty) for x in (*losses, losses[0] - losses[1])]
        return pa.table(columns, names=[part.split()[0] for part in _RESULT.split(", ")])
    return score


def score_documents(docs: DataFrame, targets: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score of every row.

    ``targets`` has the doc_id of each target document (repeats and nulls do not count).
    Words are runs of anything but ASCII white space. A text that is null or has no words
    gets null losses. Rows of one doc_id are all targets or none. Without targets every
    word costs the same under the target model. An empty table gives no rows. Keys have 47
    bits: of 1e11 different pairs about one in 1,400 shares its count with another, of the
    1e9 of a smaller corpus one in 140,000. Other columns are not used.
    """
    units = Units(docs)
    wanted = targets.where("doc_id IS NOT NULL").select("doc_id").distinct()
    packed = units.with_ids(wanted).groupBy("unit").applyInPandas(
        lambda group: pd.DataFrame(
            [(group["unit"].iloc[0], _TARGETS, 0, group["doc_id"].to_numpy("<i8").tobytes(), b"", b"")],
            columns=["unit", "step", "range", "a", "b", "c"]),
        "unit long, step int, range long, a binary, b binary, c binary")
    told = stash(packed, "targets")
    counts = units.ask(_ask(units.ranges), [told], _reply)
    size = counts.where(F.col("step") == _SIZE).agg(F.sum("range")).first()[0] or 0
    return units.run(_score(size, smoothing), _RESULT, [counts.where(F.col("step") == _KEYS)])
