"""Substring dedup by level-wise doubling of repeated word windows.

At the first level every window of a few words is a candidate; those that occur more
than once are extended to twice the length, and so on up to the wanted length. Only
a window both of whose halves are repeated is looked at again, so each level has
fewer candidates; a unit without any sends nothing. Keys are 48 bits below the
last level (an agreement by chance only keeps a candidate for longer) and 128 bits at
the last one, where the smallest doc_id of every window decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymart.llm.common import mix
from tallymart.llm.units import (
    Units, answer, cut_by_range, hashed_words, message_rows, pack48, unpack48)

WINDOW = 50
FIRST = 12
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_TIMES2 = np.uint64(0xD6E8FEB86659FD93)
_LAST_ID = np.iinfo(np.int64).max  # a null doc_id is larger than all others
_RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_text string, kept_sha256 string"


def level_lengths(window: int, first: int = FIRST) -> list[int]:
    """first or a little more, then twice as long each time, up to ``window``."""
    lengths = [window]
    while lengths[0] >= 2 * first:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def _power(times: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(times), n, 1 << 64))


def _ahead(values: np.ndarray, n: int) -> np.ndarray:
    """values[i + n]; zeros past the end, where no window stands."""
    out = np.zeros_like(values)
    if n < len(values):
        out[:len(values) - n] = values[n:]
    return out


def window_keys(words: np.ndarray, at: np.ndarray, length: int, times: np.uint64) -> np.ndarray:
    """Hashes of the windows of ``length`` words at the given places.

    A polynomial in ``times``, built for all places at once from windows of 1, 2, 4, ...
    words: some six passes over the words instead of one for each word of a window.
    """
    total, have, part, width = None, 0, words, 1
    while width <= length:
        if length & width:
            total = part if total is None else part * _power(times, have) + _ahead(total, width)
            have += width
        if 2 * width <= length:
            part = part * _power(times, width) + _ahead(part, width)
        width *= 2
    return mix(total[at])


def _candidates(words: np.ndarray, ends: np.ndarray, lengths: list[int], told: pa.Table):
    """The first level not yet answered, its candidate places and their keys.

    If all levels but the last are answered, that is the last one; its answer is
    looked at by the caller.
    """
    room = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(words))
    alive = room >= lengths[0]
    for step, length in enumerate(lengths):
        if step:
            shift = length - lengths[step - 1]
            alive = alive & np.append(alive[shift:], np.zeros(min(shift, len(alive)), bool))
            alive &= room >= length
        at = np.flatnonzero(alive)
        keys = window_keys(words, at, length, _TIMES)
        if step == len(lengths) - 1:
            break
        flags = answer(told, step)
        if flags is None:
            break
        different, which = np.unique(keys >> np.uint64(16), return_inverse=True)
        repeated = _unpack_flags(told, step, len(different))
        alive = np.zeros(len(words), bool)
        alive[at[repeated[which]]] = True
    return step, at, keys


def _unpack_flags(told: pa.Table, step: int, n: int) -> np.ndarray:
    return np.frombuffer(answer(told, step), np.uint8)[:n].astype(bool)


def _ask(lengths: list[int], ranges: int):
    def ask(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not len(docs):
            return message_rows([])
        unit = docs.column("unit")[0].as_py()
        words, ends = hashed_words(docs.column("text"))
        step, at, keys = _candidates(words, ends, lengths, told)
        rows = []
        if step < len(lengths) - 1:
            keys, counts = np.unique(keys >> np.uint64(16), return_counts=True)
            keys <<= np.uint64(16)
            cuts = cut_by_range(keys, ranges)
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    rows.append((unit, step, k, pack48(keys[i:j]),
                                 (counts[i:j] > 1).astype(np.uint8).tobytes(), b""))
        else:
            second = window_keys(words, at, lengths[-1], _TIMES2)
            owner = _doc_ids(docs)[np.searchsorted(ends, at, side="right")]
            keys, second, first_id, _ = _least(keys, second, owner)
            cuts = cut_by_range(keys, ranges)
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    rows.append((unit, step, k, keys[i:j].tobytes(), second[i:j].tobytes(),
                                 first_id[i:j].tobytes()))
        return message_rows(rows)
    return ask


def _doc_ids(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").fill_null(_LAST_ID).to_numpy()


def _least(keys: np.ndarray, second: np.ndarray, owner: np.ndarray):
    """Different (key, second) in order, the least owner of each, and which one each row is."""
    order = np.lexsort((second, keys))
    k, s = keys[order], second[order]
    opens = np.ones(len(k), bool)
    opens[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    starts = np.flatnonzero(opens)
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(opens) - 1
    least = np.minimum.reduceat(owner[order], starts) if len(starts) else owner[:0]
    return k[starts], s[starts], least, which


def _reply_repeated(group: pd.DataFrame) -> pd.DataFrame:
    parts = [unpack48(a) for a in group["a"]]
    _, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twice = np.frombuffer(b"".join(group["b"]), np.uint8).astype(bool)
    flags = ((counts[which] > 1) | twice).astype(np.uint8)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return group.assign(a=[f.tobytes() for f in np.split(flags, cuts)], b=b"", c=b"")


def _reply_least(group: pd.DataFrame) -> pd.DataFrame:
    keys, second = (np.frombuffer(b"".join(group[c]), "<u8") for c in ("a", "b"))
    owner = np.frombuffer(b"".join(group["c"]), "<i8")
    _, _, least, which = _least(keys, second, owner)
    cuts = np.cumsum([len(c) // 8 for c in group["c"]])[:-1]
    return group.assign(a=[x.tobytes() for x in np.split(least[which], cuts)], b=b"", c=b"")


def _finish(lengths: list[int]):
    def finish(docs: pa.Table, told: pa.Table) -> pa.Table:
        texts = docs.column("text")
        words, ends = hashed_words(texts)
        gone = np.zeros(len(words), bool)
        if told is not None and len(words):
            step, at, keys = _candidates(words, ends, lengths, told)
            found = answer(told, step)
            if step == len(lengths) - 1 and found:
                second = window_keys(words, at, lengths[-1], _TIMES2)
                owner = _doc_ids(docs)[np.searchsorted(ends, at, side="right")]
                _, _, _, which = _least(keys, second, owner)
                starts = at[np.frombuffer(found, "<i8")[which] < owner]
                change = np.zeros(len(words) + 1, np.int64)
                change[starts] += 1
                change[starts + lengths[-1]] -= 1
                gone = np.cumsum(change)[:-1] > 0
        rows = []
        for doc_id, text, a, b in zip(docs.column("doc_id").to_pylist(), texts,
                                      np.append(0, ends[:-1]), ends):
            mask = gone[a:b]
            kept = text.as_py().encode().split()
            if mask.any():
                kept = [w for w, g in zip(kept, mask) if not g]
            rest = b" ".join(kept)
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if b > a else 0
            rows.append((doc_id, int(b - a), int(mask.sum()), spans, rest.decode(),
                         hashlib.sha256(rest).hexdigest()))
        types = [pa.int64()] * 4 + [pa.string()] * 2
        names = [part.split()[0] for part in _RESULT.split(", ")]
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return finish


def dedup_windows(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_text and kept_sha256 of every row.

    Words are runs of anything but ASCII white space. A word goes if a window of
    ``window`` words that covers it also starts in a row with a smaller doc_id; rows of
    one doc_id do not count against each other, and a null id is larger than all others.
    A null text has no words, and an empty table gives no rows. Other columns are not used.
    """
    units = Units(docs)
    lengths = level_lengths(window, first)
    answers: list[DataFrame] = []
    for step in range(len(lengths)):
        last = step == len(lengths) - 1
        reply = units.ask(_ask(lengths, units.ranges), answers,
                          _reply_least if last else _reply_repeated)
        answers.append(reply)
    return units.run(_finish(lengths), _RESULT, answers)
