"""Exact dedup: binary-fuse filters over immutable snapshots of text digests.

Every batch of documents becomes a snapshot that never changes: a table of its new
texts (digest, keeper) and, per digest bucket, a static three-wise binary-fuse
filter of one byte a key. An incoming batch is first grouped on its own; its
distinct digests are then screened by the filters of all earlier snapshots, only
positives are joined with the exact tables, and what no snapshot has makes up the
next one. Finally the bytes of all texts that share a digest are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import WHITE_RUN, id_ranges, in_range, mix, whole_texts
from tallymart.session import stash

_KEYS_IN_FILTER = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class BinaryFuse:
    """A set of distinct 64-bit keys; says yes to every key of it and to 1 in 256 others."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = max(len(keys), 1)
        segment = 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        segments = max(1, int(np.ceil(room / segment)) - 1)
        for seed in range(1, 1000):
            built = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if built._peel(keys):
                return built
            segments += seed % 5 == 0  # more room if luck does not help
        raise ValueError("no filter found")

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64(self.seed * int(_ODD) % (1 << 64)))
        start = (((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)).astype(np.int64)
        mask = np.uint64(self.segment - 1)
        inside = [(h >> np.uint64(s)) & mask for s in (0, 18)] + [mix(h) & mask]
        places = np.stack([(start + i) * self.segment + x.astype(np.int64)
                           for i, x in enumerate(inside)])
        return places, (mix(h ^ _ODD) & np.uint64(0xFF)).astype(np.uint8)

    def _peel(self, keys: np.ndarray) -> bool:
        places, prints = self._places(keys)
        size = len(self.table)
        count = np.bincount(places.ravel(), minlength=size)
        index = np.zeros(size, np.int64)  # the xor of the keys at a place: the key, if it is alone
        for row in places:
            np.bitwise_xor.at(index, row, np.arange(len(keys)))
        left, order = len(keys), []
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                return False
            which, first = np.unique(index[alone], return_index=True)
            order.append((which, alone[first]))
            for row in places:
                np.subtract.at(count, row[which], 1)
                np.bitwise_xor.at(index, row[which], which)
            left -= len(which)
        for which, at in reversed(order):
            other = self.table[places[0][which]] ^ self.table[places[1][which]] \
                ^ self.table[places[2][which]] ^ self.table[at]
            self.table[at] = prints[which] ^ other
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(np.asarray(keys, np.uint64))
        t = self.table
        return (t[places[0]] ^ t[places[1]] ^ t[places[2]]) == prints

    def to_bytes(self) -> bytes:
        head = np.array([self.seed, self.segment, self.segments], "<u8")
        return head.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        seed, segment, segments = (int(x) for x in np.frombuffer(data, "<u8", 3))
        return cls(seed, segment, segments, np.frombuffer(data, np.uint8, offset=24))


def _key64(sha: pd.Series) -> np.ndarray:
    """The second eight bytes of each digest; the first ones choose the bucket."""
    return np.frombuffer(b"".join(x[8:16] for x in sha), "<u8")


def _build_filter(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]],
                         "filter": [BinaryFuse.build(_key64(group["sha"])).to_bytes()]})


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The digests of the batch to which the filter of any snapshot says yes."""
    keys, maybe = _key64(batch["sha"]), np.zeros(len(batch), bool)
    for data in filters["filter"]:
        maybe |= BinaryFuse.from_bytes(data).has(keys)
    return batch.loc[maybe, ["sha"]]


def snapshot_filters(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("bucket", "sha").groupBy("bucket").applyInPandas(
        _build_filter, "bucket long, filter binary")


def normal_text(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).select(
        "doc_id", F.regexp_replace("text", WHITE_RUN, " ").alias("norm"))


def exact_groups(docs: DataFrame, batches: int = 4, compare_bytes: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when they are so after replacing runs of ASCII white space by one
    space; null is the empty text. keep_id is the group's smallest doc_id (null ids
    sort last). Of several rows with that same doc_id all count as kept. Batches are
    doc_id ranges in ascending order. Other columns are not used.

    Raises ValueError if two texts that differ have one SHA-256.
    """
    digests = stash(normal_text(docs).select(
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha")), "text-digests")
    rows = digests.count()
    buckets = max(128, -(-rows // _KEYS_IN_FILTER))
    bucket = F.pmod(F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long"), F.lit(buckets))

    snapshots: list[DataFrame] = []
    filters: list[DataFrame] = []
    for bounds in id_ranges(digests, batches):
        # Copies within the batch are grouped first: one row a digest from here on.
        batch = stash(digests.where(in_range(bounds)).groupBy("sha").agg(
            F.min("doc_id").alias("keep_id")).withColumn("bucket", bucket), "batch")
        fresh = batch
        if snapshots:
            known, screens = snapshots[0], filters[0]
            for snapshot, screen in zip(snapshots[1:], filters[1:]):
                known, screens = known.unionByName(snapshot), screens.unionByName(screen)
            maybe = batch.groupBy("bucket").cogroup(screens.groupBy("bucket")).applyInPandas(
                lambda left, right: _screen(left, right), "sha binary")
            seen = maybe.join(known.select("sha"), "sha", "left_semi")
            fresh = batch.join(seen, "sha", "left_anti")
        snapshots.append(stash(fresh, "snapshot"))
        filters.append(stash(snapshot_filters(snapshots[-1]), "snapshot-filter"))
    keepers = snapshots[0]
    for snapshot in snapshots[1:]:
        keepers = keepers.unionByName(snapshot)
    sizes = digests.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"))
    groups = stash(keepers.select("sha", "keep_id").join(sizes, "sha"), "text-groups")
    if compare_bytes:
        _same_bytes(docs, digests, groups)
    return digests.join(groups, "sha").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def _same_bytes(docs: DataFrame, digests: DataFrame, groups: DataFrame) -> None:
    shared = groups.where("group_size > 1").select("sha")
    texts = normal_text(docs).withColumn("sha", F.unhex(F.sha2("norm", 256))).join(
        shared, "sha", "left_semi")
    # Equal copies are folded before the shuffle, so one text arrives once a task.
    differing = texts.groupBy("sha", "norm").agg(F.lit(1).alias("_")).groupBy("sha").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1")
    if differing.limit(1).count():
        raise ValueError("texts that differ share a SHA-256 digest")


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
           FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
