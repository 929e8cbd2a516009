"""Suffix-array dedup: the difference-cover algorithm over repeated stretches of bytes.

Two lossless steps come first. Every 50-byte string is stood for by its least 24-byte
gram; strings whose gram occurs once in the corpus are not repeated, and only the
stretches covered by the others go on. Equal stretches enter once, under the smallest
doc_id that has them.

The suffixes of these stretches are then sorted as far as 50 bytes. Positions that are
1 or 2 modulo 3 are the sample. Their triples of bytes are names already; triples of
names are sorted and named twice more (9, then 27 bytes), which is the recursion on
names, ended where a pair of names reaches far enough. A name that one sample position
alone has is settled: no string with it is repeated at that shift, and it goes no
further. The remaining positions are merged in by the cover property: whatever two positions are compared, going on 0, 1
or 2 bytes brings both to sample positions, so a position is keyed by those of its
shifts that do. Equal neighbours in that order are equal 50-byte strings, and the
smallest doc_id among them decides. Sorting is by ranges of the keys, cut at quantiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import mix
from tallymart.llm.units import MESSAGE, Units, answer, cut_by_range, message_rows, pack48, unpack48
from tallymart.session import stash

LENGTH = 50
_GRAM = 24
_WINDOW = LENGTH - _GRAM + 1  # grams in a string
_TIMES = 0x9E3779B97F4A7C15
_LAST_ID = np.iinfo(np.int64).max
_STRETCH = "doc_id long, unit long, row long, at long, digest binary, bytes binary"
_RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, "
           "kept_sha256 string")


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_TIMES, n, 1 << 64))


def _ahead(values: np.ndarray, n: int) -> np.ndarray:
    """values[i + n]; past the end the last one."""
    return np.concatenate([values[n:], np.repeat(values[-1:], min(n, len(values)))])


_BYTE_HASHES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
#: Bytes hashed at a time: arrays of this length stay in a processor's cache.
_STRIP = 1 << 16


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    eight = _BYTE_HASHES[data]
    for n in (1, 2, 4):
        eight = eight * _power(n) + _ahead(eight, n)
    sixteen = eight * _power(8) + _ahead(eight, 8)
    return mix(sixteen * _power(8) + _ahead(eight, 16))


def _slide(values: np.ndarray, n: int, least) -> np.ndarray:
    """least (a ufunc) over values[i : i + n] for every i."""
    width = 1
    while 2 * width <= n:
        values, width = least(values, _ahead(values, width)), 2 * width
    return least(values, _ahead(values, n - width)) if n > width else values


def _strips(n: int) -> Iterator[tuple[slice, slice]]:
    """Strips of 0..n with room around them for all that a place looks at, and their core inside."""
    for a in range(0, n, _STRIP):
        low, high = max(0, a - _WINDOW), min(n, a + _STRIP + _GRAM + 2 * _WINDOW)
        yield slice(low, high), slice(a - low, min(a + _STRIP, n) - low)


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, the least one of the string from each place, and which grams are least of one."""
    parts = []
    for around, core in _strips(len(data)):
        h = _gram_hashes(data[around])
        least = _slide(h, _WINDOW, np.minimum)
        most = _slide(least[::-1], _WINDOW, np.maximum)[::-1]
        parts.append((h[core], least[core], (h <= most)[core]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _sorted_rows(docs: pa.Table) -> tuple[list, list[bytes]]:
    """Rows of a unit in an order that only depends on what is in them."""
    texts = [t.as_py() for t in docs.column("text")]
    ids = docs.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def _ask_anchors(ranges: int):
    def ask(docs: pa.Table, told: pa.Table) -> pa.Table:
        _, texts = _sorted_rows(docs)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return message_rows([])
        h, _, anchor = _anchors(data)
        keys, counts = np.unique(h[anchor] >> np.uint64(16), return_counts=True)
        keys <<= np.uint64(16)
        cuts = cut_by_range(keys, ranges)
        unit = docs.column("unit")[0].as_py()
        return message_rows([(unit, 0, k, pack48(keys[i:j]), (counts[i:j] > 1).astype(np.uint8).tobytes(), b"")
                             for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j])
    return ask


def _reply_repeated(group: pd.DataFrame) -> pd.DataFrame:
    parts = [unpack48(a) for a in group["a"]]
    _, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twice = np.frombuffer(b"".join(group["b"]), np.uint8).astype(bool)
    flags = ((counts[which] > 1) | twice).astype(np.uint8)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return group.assign(a=[f.tobytes() for f in np.split(flags, cuts)], b=b"", c=b"")


def _stretches(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Stretches of every text that its possibly repeated strings cover."""
    ids, texts = _sorted_rows(docs)
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows = []
    if len(data):
        h, least, anchor = _anchors(data)
        at = np.flatnonzero(anchor)
        different, which = np.unique(h[at] >> np.uint64(16), return_inverse=True)
        repeated = np.frombuffer(answer(told, 0), np.uint8)[:len(different)].astype(bool)
        kept = np.full(len(h), np.iinfo(np.uint64).max)
        kept[at[repeated[which]]] = h[at[repeated[which]]]
        maybe = np.concatenate([_slide(kept[around], _WINDOW, np.minimum)[core] == least[around][core]
                                for around, core in _strips(len(kept))])
        unit, begin = docs.column("unit")[0].as_py(), 0
        for row, (doc_id, text) in enumerate(zip(ids, texts)):
            starts = np.flatnonzero(maybe[begin:begin + max(0, len(text) - LENGTH + 1)])
            begin += len(text)
            if len(starts):
                gap = np.flatnonzero(np.diff(starts) > LENGTH)
                for a, b in zip(starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)]):
                    piece = text[a:b + LENGTH]
                    rows.append((doc_id, unit, row, int(a), hashlib.sha256(piece).digest(), piece))
    types = [pa.int64()] * 4 + [pa.binary()] * 2
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)],
                    names=[part.split()[0] for part in _STRETCH.split(", ")])


# --- the difference-cover sort of the stretches -----------------------------------------

def _packed(columns: list[np.ndarray], bits: list[int]) -> np.ndarray | None:
    """Columns of so many bits side by side in one number that sorts alike, if they fit."""
    if sum(bits) > 64:
        return None
    key = columns[0].astype(np.uint64)
    for c, n in zip(columns[1:], bits[1:]):
        key = (key << np.uint64(n)) | c.astype(np.uint64)
    return key


def _distinct(columns: list[np.ndarray], bits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One row of each of the different rows, in lexicographic order, and which of them each row is."""
    packed = _packed(columns, bits) if bits else None
    if packed is None:
        order = np.lexsort(columns[::-1])
    else:
        order, columns = np.argsort(packed), [packed]
    opens = np.zeros(len(order), bool)
    opens[:1] = True
    for c in columns:
        c = c[order]
        opens[1:] |= c[1:] != c[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(opens) - 1
    return order[opens], which


def _ranked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and which of them each value is."""
    order = np.argsort(packed)
    values = packed[order]
    opens = np.ones(len(values), bool)
    opens[1:] = values[1:] != values[:-1]
    which = np.empty(len(order), np.int32)  # a unit has some millions of places
    which[order] = np.cumsum(opens, dtype=np.int32) - np.int32(1)
    return values[opens], which


def _counted(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and whether each occurs twice or more: no places, so a plain sort does."""
    values = np.sort(packed)
    opens = np.ones(len(values) + 1, bool)
    opens[1:-1] = values[1:] != values[:-1]
    return values[opens[:-1]], np.diff(np.flatnonzero(opens)) > 1


def _fields(packed: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    """The n fields of so many bits that ``_packed`` put together."""
    mask = np.uint64((1 << bits) - 1)
    return [(packed >> np.uint64(bits * k)) & mask for k in reversed(range(n))]


def _squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length; the first one is sorted and kept as steps."""
    steps = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    planes, widths = [], []
    for c in (steps, *columns[1:]):
        widths.append(max(1, (int(c.max(initial=0)).bit_length() + 7) // 8))
        planes.append(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :widths[-1]].T.tobytes())
    raw = b"".join(planes)
    head = bytes(widths) + len(raw).to_bytes(8, "little")
    return head + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True) if raw else head


def _expand(data: bytes, n: int) -> list[np.ndarray]:
    widths, length = data[:n], int.from_bytes(data[n:n + 8], "little")
    raw = pa.decompress(data[n + 8:], length, codec="zstd", asbytes=True) if length else b""
    raw = np.frombuffer(raw, np.uint8)
    size = len(raw) // sum(widths)
    columns, begin = [], 0
    for width in widths:
        column = np.zeros((size, 8), np.uint8)
        column[:, :width] = raw[begin:begin + width * size].reshape(width, size).T
        columns.append(column.reshape(-1).view("<u8"))
        begin += width * size
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


class _Stretches:
    """The stretches of a unit laid end to end, with the names known so far."""

    def __init__(self, docs: pa.Table):
        rows = sorted(zip(docs.column("digest").to_pylist(), docs.column("doc_id").to_pylist(),
                          docs.column("text").to_pylist()))
        self.digests = [r[0] for r in rows]
        self.owners = np.array([r[1] for r in rows], np.int64)
        self.sizes = np.array([len(r[2]) for r in rows], np.int64)
        self.data = np.frombuffer(b"".join(r[2] for r in rows) + bytes(128), np.uint8)
        self.n = len(self.data) - 128
        place = np.arange(self.n + 64)
        self.sample = place[place % 3 != 0]

    def _eight(self) -> np.ndarray:
        """The eight bytes from each sample position as one number, the first byte on top."""
        eight = self.data.astype(np.uint64)
        for n in (1, 2, 4):
            eight = (eight << np.uint64(8 * n)) | _ahead(eight, n)
        return eight[self.sample]

    def nine(self, places: bool):
        """The different nine bytes from sample positions (three triples, in two numbers), and
        which of them each position has, or, without ``places``, whether each occurs twice."""
        used = np.flatnonzero(np.bincount(self.data, minlength=256))
        bits = int(len(used) - 1).bit_length()
        if 9 * bits > 64:
            columns = [self._eight(), self.data[self.sample + 8].astype(np.uint64)]
            first, which = _distinct(columns)
            return [c[first] for c in columns], which if places else np.bincount(which) > 1
        # Few different bytes: all nine in one number, built up from 1, 2, 4 and 8 of them.
        letter = np.zeros(256, np.uint64)
        letter[used] = np.arange(len(used))
        one = letter[self.data]
        nine = one
        for n in (1, 2, 4):
            nine = (nine << np.uint64(bits * n)) | _ahead(nine, n)
        nine = (nine << np.uint64(bits)) | _ahead(one, 8)
        values, found = (_ranked if places else _counted)(nine[self.sample])
        letters = [used[f].astype(np.uint64) for f in _fields(values, bits, 9)] if bits else [
            np.full(len(values), used[0], np.uint64)] * 9
        high = np.zeros(len(values), np.uint64)
        for x in letters[:8]:
            high = (high << np.uint64(8)) | x
        return [high, letters[8]], found

    def ranks(self, places: np.ndarray, which: np.ndarray, names: np.ndarray) -> np.ndarray:
        """For every place one more than the number of its name, 0 where it is settled or has none."""
        full = np.zeros(self.n + 128, np.int32)
        open_ = names > 0
        full[places] = (which + 1) * open_[which]
        return full

    def twenty_seven(self, ranks: np.ndarray, names: np.ndarray, places: bool):
        """Sample places with three names not settled, their different names, and as ``nine`` does."""
        at = self.sample[ranks[self.sample] > 0]
        at = at[at < self.n]
        at = at[(ranks[at + 9] > 0) & (ranks[at + 18] > 0)]
        columns = [ranks[at + k] - 1 for k in (0, 9, 18)]
        bits = len(names).bit_length()
        packed = _packed(columns, [bits] * 3)
        if packed is None:
            first, which = _distinct(columns)
            return at, [names[c[first]] for c in columns], which if places else np.bincount(which) > 1
        values, found = (_ranked if places else _counted)(packed)
        return at, [names[f.astype(np.int64)] for f in _fields(values, bits, 3)], found

    def merged(self, ranks: np.ndarray, names: np.ndarray, places: bool = True):
        """Places whose 50 bytes lie in a stretch, once for each shift to the sample whose names
        are not settled; their different keys, and which each has."""
        room = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(self.n)
        inside = room >= LENGTH
        parts = []
        for shift in range(3):
            a = np.flatnonzero(inside & (ranks[shift:self.n + shift] > 0)
                               & (ranks[shift + 21:self.n + shift + 21] > 0))
            first = a + shift  # two names of 27 bytes, 21 apart, are 48 bytes; two are left
            rest = [self.data[a + k] if k < shift else self.data[a + 48 + k] for k in range(2)]
            left = (shift << 16) | (rest[0].astype(np.int64) << 8) | rest[1]
            parts.append((a, ranks[first] - 1, ranks[first + 21] - 1, left))
        at, one, two, left = (np.concatenate(c) for c in zip(*parts))
        bits = len(names).bit_length()
        packed = _packed([one, two, left], [bits, bits, 18])
        if packed is None:
            first, which = _distinct([one, two, left])
            return at, [names[one[first]], names[two[first]], left[first].astype(np.uint64)], which
        values, which = _ranked(packed)
        left = values & np.uint64((1 << 18) - 1)
        one, two = (f.astype(np.int64) for f in _fields(values >> np.uint64(18), bits, 2))
        return at, [names[one], names[two], left], which


_STEPS = ("nine", "twenty-seven", "merge")


def _round(docs: pa.Table, told: pa.Table):
    """The step not answered yet with its different keys, or the last with its answer.

    Of the first two steps the last thing but one says which keys occur twice, for that is
    all that asking needs; of the merge it says which key each place has.
    """
    s = _Stretches(docs)
    names = answer_names(told, 0)
    if names is None:
        return s, 0, *s.nine(False), s.sample
    _, which = s.nine(True)
    at = s.sample
    for step, then in ((1, s.twenty_seven), (2, s.merged)):
        ranks = s.ranks(at, which, names)
        held, names = names, answer_names(told, step) if step < 2 else None
        at, keys, which = then(ranks, held, names is not None or step == 2)
        if names is None or step == 2:
            return s, step, keys, which, at


def answer_names(told: pa.Table, step: int) -> np.ndarray | None:
    """What came back for each key of a step; a settled name is 0. None if nothing was asked."""
    steps, ranges = told.column("step").to_numpy(), told.column("range").to_numpy()
    rows = np.flatnonzero(steps == step)
    if not len(rows):
        return None
    a, b, c = (told.column(name) for name in "abc")
    parts = []
    for i in map(int, rows[np.argsort(ranges[rows], kind="stable")]):
        values = _expand(a[i].as_py(), 1)[0]
        if step < 2:
            n = int.from_bytes(c[i].as_py(), "little")
            open_ = np.unpackbits(np.frombuffer(b[i].as_py(), np.uint8), count=n).astype(bool)
            named = np.zeros(n, np.uint64)
            named[open_] = (np.uint64(int(ranges[i])) << np.uint64(40)) | values
            values = named
        parts.append(values)
    return np.concatenate(parts)


def _ask_names(edges: np.ndarray):
    def ask(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not len(docs):
            return message_rows([])
        unit = docs.column("unit")[0].as_py()
        s, step, keys, which, at = _round(docs, told)
        ranges = np.searchsorted(edges, keys[0], side="right") if step == 0 else keys[0] >> np.uint64(40)
        cuts = np.flatnonzero(np.diff(ranges.astype(np.int64), prepend=-1, append=1 << 40))
        columns = list(keys)
        twice = which if step < 2 else np.bincount(which, minlength=len(keys[0])) > 1
        if step == 2:  # the smallest owner of each string in this unit goes along
            owner = np.repeat(s.owners, s.sizes)[at]
            least = np.full(len(keys[0]), _LAST_ID)
            np.minimum.at(least, which, owner)
            columns.append(least.astype(np.uint64))
        return message_rows([
            (unit, step, int(ranges[i]), _squeeze([c[i:j] for c in columns]),
             np.packbits(twice[i:j]).tobytes(), len(columns).to_bytes(1, "little")) for i, j in zip(cuts[:-1], cuts[1:])])
    return ask


def _reply_names(group: pd.DataFrame) -> pd.DataFrame:
    """Names in key order, of those not settled, for the first two steps; the smallest owner for the last."""
    parts = [_expand(a, c[0]) for a, c in zip(group["a"], group["c"])]
    columns = [np.concatenate(c) for c in zip(*parts)]
    sizes = [len(p[0]) for p in parts]
    cuts = np.cumsum(sizes)[:-1]
    if group["step"].iloc[0] == 2:
        first, which = _distinct(columns[:3])
        least = np.full(len(first), _LAST_ID)
        np.minimum.at(least, which, columns[3].astype(np.int64))
        return group.assign(a=[_squeeze([x]) for x in np.split(least[which].astype(np.uint64), cuts)],
                            b=b"", c=b"")
    first, which = _distinct(columns)
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n)
                            for b, n in zip(group["b"], sizes)]).astype(bool)
    repeated = np.bincount(which) > 1
    repeated[which[twice]] = True
    open_ = repeated[which]
    names = (which + 1).astype(np.uint64)
    return group.assign(
        a=[_squeeze([x[o]]) for x, o in zip(np.split(names, cuts), np.split(open_, cuts))],
        b=[np.packbits(o).tobytes() for o in np.split(open_, cuts)],
        c=[n.to_bytes(8, "little") for n in sizes])


def _sampled_keys(docs: pa.Table, told: pa.Table) -> pa.Table:
    keys = _Stretches(docs)._eight()
    picked = np.unique(keys[mix(keys) % np.uint64(997) == 0]) ^ np.uint64(1 << 63)
    return pa.table({"key": pa.array(picked.view(np.int64))})


def _later_starts(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Of every stretch, the places whose 50 bytes also start in a smaller doc_id."""
    s, step, _, which, at = _round(docs, told)
    starts = np.zeros(s.n, bool)
    least = answer_names(told, 2)
    if least is not None and step == 2:  # without an answer there was no key left to ask about
        owner = np.repeat(s.owners, s.sizes)[at].astype(np.uint64)
        starts[at[least[which] < owner]] = True
    flags = [np.packbits(x).tobytes() for x in np.split(starts, np.cumsum(s.sizes)[:-1])]
    return pa.table({"digest": pa.array(s.digests, pa.binary()),
                     "owner": pa.array(s.owners), "starts": pa.array(flags, pa.binary())})


class _StretchUnits(Units):
    """Units of different stretches, dealt by their digest."""

    def __init__(self, stretches: DataFrame):
        one = stretches.select(
            F.col("digest"), F.col("owner").alias("doc_id"), F.col("bytes").alias("text"))
        super().__init__(one, unit_bytes=3_000_000)

    def columns(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", "text", "digest")

    def unit_of(self):
        return F.pmod(F.xxhash64(F.col("digest")), F.lit(self.count))


def _finish(docs: pa.Table, told: pa.Table) -> pa.Table:
    ids, texts = _sorted_rows(docs)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    change = np.zeros((int(ends[-1]) if len(ends) else 0) + 1, np.int64)
    for row, at, size, flags in zip(*(told.column(c).to_pylist() for c in ("row", "at", "size", "starts"))):
        begin = int(ends[row]) - len(texts[row]) + at
        if flags is None:  # another row's stretch with a smaller doc_id: all of it goes
            change[begin] += 1
            change[begin + size] -= 1
        else:
            starts = np.flatnonzero(np.unpackbits(np.frombuffer(flags, np.uint8), count=size)) + begin
            change[starts] += 1
            np.subtract.at(change, starts + LENGTH, 1)
    gone = np.cumsum(change)[:-1] > 0
    rows = []
    for doc_id, text, end in zip(ids, texts, ends):
        mask = gone[end - len(text):end]
        kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
        rows.append((doc_id, len(text), int(mask.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
    types = [pa.int64()] * 4 + [pa.binary(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)],
                    names=[part.split()[0] for part in _RESULT.split(", ")])


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept and kept_sha256 of every row.

    Texts are UTF-8 bytes, null is empty. A byte goes if a 50-byte string that covers it
    also starts in a row with a smaller doc_id; rows of one doc_id do not count against
    each other, and a null id is larger than all others. ``kept`` may cut a character, so
    it is binary. An empty table gives no rows. Other columns are not used.
    """
    units = Units(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    repeated = units.ask(_ask_anchors(units.ranges), [], _reply_repeated)
    found = stash(units.run(_stretches, _STRETCH, [repeated]), "stretches", "zstd")
    rank = F.coalesce("doc_id", F.lit(_LAST_ID))
    owned = found.groupBy("digest").agg(
        F.min(rank).alias("owner"), F.min_by("bytes", "at").alias("bytes"))
    parts = _StretchUnits(owned)
    sample = stash(parts.run(_sampled_keys, "key long", []), "key-sample")
    quantiles = [k / parts.ranges for k in range(1, parts.ranges)]
    cuts = sample.agg(F.percentile_approx("key", quantiles, 10_000)).first()[0] or []
    edges = np.unique(np.array(cuts, np.int64).view(np.uint64) ^ np.uint64(1 << 63))
    answers: list[DataFrame] = []
    for _ in _STEPS:
        answers.append(parts.ask(_ask_names(edges), answers, _reply_names))
    later = stash(parts.run(_later_starts, "digest binary, owner long, starts binary", answers),
                  "later-starts")
    marks = found.select("unit", "row", "at", "digest", F.octet_length("bytes").alias("size"),
                         rank.alias("_rank")).join(later, "digest").select(
        "unit", "row", "at", F.col("size").cast("long").alias("size"),
        F.when(F.col("_rank") == F.col("owner"), F.col("starts")).alias("starts"))
    return units.table.groupBy("unit").cogroup(marks.groupBy("unit")).applyInArrow(_finish, _RESULT)
