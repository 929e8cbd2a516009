"""SimHash near-dedup by a self-join of the fingerprints' binary trie.

The trie is walked in pairs of nodes from the root pair down: the children of a
pair are its four pairs of child nodes, the differing bits add up, and a pair above
the error budget is dropped. The upper part of the walk is a DataFrame of node
pairs, four bits a step; a pair whose nodes hold few enough fingerprints is handed,
with both lists, to a task that walks the rest of the two subtries in memory.
Crowded nodes are simply walked further, so a task's work is bounded whatever the
groups look like. Links of one pair of nodes come back as a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import digest, text_rows, whole_texts
from tallymart.llm.components import components
from tallymart.session import stash

SEED = 42
_BITS = 64
_STEP = 4


def fingerprint_words(words: list[bytes], shingle: int = 3) -> np.ndarray:
    """The shingles' hashes, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    last = max(1, len(words) - shingle + 1)
    return np.fromiter((h(b" ".join(words[i:i + shingle]), SEED) for i in range(last)),
                       np.uint64, last)


def fingerprints_of(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One fingerprint per run of hashes: a bit is set where over half the hashes have it."""
    out = np.zeros(len(ends), np.uint64)
    sizes = np.diff(np.append(0, ends))
    full = sizes > 0
    starts = (ends - sizes)[full]
    if len(starts):
        for bit in range(_BITS):
            ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), starts)
            out[full] |= (2 * ones > sizes[full].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, digests: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long, of every row; digest (MD5 of the text) if asked.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle, one without words (or null) gets zero.
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_rows(batches, 2_000_000):
            # bytes.lower and bytes.split know exactly A-Z and the six ASCII spaces
            found = [fingerprint_words(t.lower().split(), shingle) for t in texts]
            ends = np.cumsum([len(f) for f in found])
            prints = fingerprints_of(np.concatenate(found), ends)
            columns = [pa.array(ids, pa.int64()), pa.array(prints.view(np.int64))]
            if digests:
                columns.append(pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "fp", "digest"][:3 if digests else 2]
    return whole_texts(docs).mapInArrow(compute, "doc_id long, fp long" + ", digest binary" * digests)


def _walk(a: np.ndarray, b: np.ndarray, depth: int, cost: int, budget: int,
          leaf: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted ``a`` and ``b`` that differ in at most ``budget`` bits.

    All of ``a`` share their first ``depth`` bits, all of ``b`` theirs, and these differ
    in ``cost``. The frontier holds ranges of both arrays, one range a node.
    """
    work = [(depth, np.array([[0, len(a), 0, len(b), cost]], np.int64))]
    while work:
        depth, front = work.pop()
        small = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2]) <= leaf
        if depth == _BITS:
            small[:] = True
        for lo, hi, lo2, hi2, _ in front[small]:
            near = np.bitwise_count(a[lo:hi, None] ^ b[None, lo2:hi2]) <= budget
            i, j = np.nonzero(near)
            if len(i):
                yield i + lo, j + lo2
        front = front[~small]
        if not len(front):
            continue
        bit = np.uint64(_BITS - 1 - depth)

        def middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            cut = ((values[lo] >> bit) | np.uint64(1)) << bit
            return np.clip(np.searchsorted(values, cut), lo, hi)

        mid, mid2 = middle(a, front[:, 0], front[:, 1]), middle(b, front[:, 2], front[:, 3])
        halves = [(front[:, 0], mid), (mid, front[:, 1])], [(front[:, 2], mid2), (mid2, front[:, 3])]
        children = [np.stack([*x, *y, front[:, 4] + (p != q)], axis=1)
                    for p, x in enumerate(halves[0]) for q, y in enumerate(halves[1])]
        front = np.concatenate(children)
        front = front[(front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3])
                      & (front[:, 4] <= budget)]
        work += [(depth + 1, part) for part in np.array_split(front, len(front) // 50_000 + 1)
                 if len(part)]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest node that each of n nodes is linked to; pairs are used up as they come."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            if (x == y).all():
                break
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root != root[root]).any():
                root = root[root]
    return root


def _subtrie_links(budget: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                depth, cost, same = (batch.column(c)[row].as_py() for c in ("depth", "cost", "same"))
                left, right = (np.sort(batch.column(c)[row].values.to_numpy().view(np.uint64))
                               for c in ("left", "right"))
                values = left if same else np.concatenate([left, right])
                shift = 0 if same else len(left)
                root = _forest(len(values), (
                    (i, j + shift) for i, j in _walk(left, right, depth, cost, budget)))
                moved = np.flatnonzero(root != np.arange(len(root)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values[moved].view(np.int64)),
                         pa.array(values[root[moved]].view(np.int64))], ["a", "b"])
    return links


def trie_links(prints: DataFrame, budget: int = 2, node_size: int = 1024) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints within ``budget`` bits, as forests.

    ``prints`` has distinct longs fp. Not every near pair is given, but the links have
    the same connected components as all of them.
    """
    spark = prints.sparkSession

    def prefix(depth: int):
        return F.shiftrightunsigned("fp", _BITS - depth) if depth < _BITS else F.col("fp")

    depth = 8
    nodes = prints.groupBy(prefix(depth).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    nodes = stash(nodes, "trie-nodes")
    left = nodes.select(F.col("p").alias("x"), F.col("n").alias("nx"))
    right = nodes.select(F.col("p").alias("y"), F.col("n").alias("ny"))
    # From the root pair to the 256 nodes at depth 8, in four-bit steps over their prefixes.
    front = spark.createDataFrame([(0, 0, 0)], "x long, y long, cost int")
    for at in (4, 8):
        level = nodes.select(F.shiftrightunsigned("p", 8 - at).alias("c")).distinct()
        front = _children(front, level, budget)
    front = front.join(left, "x").join(right, "y")
    ready = []
    while True:
        front = stash(front, "trie-pairs")
        few = (F.greatest("nx", "ny") <= node_size) if depth < _BITS else F.lit(True)
        ready.append((depth, front.where(few)))
        crowded = front.where(~few)
        if depth == _BITS or crowded.limit(1).count() == 0:
            break
        depth += _STEP
        wanted = crowded.select(F.col("x").alias("up")).union(crowded.select("y")).distinct()
        nodes = stash(prints.select(prefix(depth).alias("p"), prefix(depth - _STEP).alias("up")).join(
            wanted, "up", "left_semi").groupBy("p").agg(F.count(F.lit(1)).alias("n")), "trie-nodes")
        level = nodes.select(F.col("p").alias("c"))
        front = _children(crowded.select("x", "y", "cost"), level, budget).join(
            nodes.select(F.col("p").alias("x"), F.col("n").alias("nx")), "x").join(
            nodes.select(F.col("p").alias("y"), F.col("n").alias("ny")), "y")

    joined = None
    for depth, pairs in ready:
        used = pairs.select(F.col("x").alias("p")).union(pairs.select("y")).distinct()
        packed = prints.select("fp", prefix(depth).alias("p")).join(used, "p", "left_semi").groupBy(
            "p").agg(F.collect_list("fp").alias("fps"))  # at most node_size of them
        packed = stash(packed, "trie-leaves")
        rows = pairs.join(packed.select(F.col("p").alias("x"), F.col("fps").alias("left")), "x").join(
            packed.select(F.col("p").alias("y"), F.col("fps").alias("right")), "y").select(
            F.lit(depth).alias("depth"), "cost", (F.col("x") == F.col("y")).alias("same"),
            "left", "right")
        joined = rows if joined is None else joined.unionByName(rows)
    return joined.mapInArrow(_subtrie_links(budget), "a long, b long")


def _children(pairs: DataFrame, level: DataFrame, budget: int) -> DataFrame:
    """Node pairs one step of four bits further down, within the budget, each once."""
    up = F.shiftrightunsigned("c", _STEP)
    xs = level.select(up.alias("x"), F.col("c").alias("cx"))
    ys = level.select(up.alias("y"), F.col("c").alias("cy"))
    both = pairs.join(xs, "x").join(ys, "y")
    grown = both.select(
        F.col("cx").alias("x"), F.col("cy").alias("y"),
        (F.col("cost") + F.bit_count(
            (F.col("cx").bitwiseXOR(F.col("cy"))).bitwiseAND(F.lit((1 << _STEP) - 1)))
         ).cast("int").alias("cost"))
    return grown.where((F.col("cost") <= budget) & (F.col("x") <= F.col("y")))


def _labelled(docs: DataFrame, budget: int, shingle: int, digests: bool) -> DataFrame:
    """Fingerprints with root, a fingerprint that stands for the group, and component_id."""
    prints = stash(fingerprints(docs, shingle, digests), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    roots = components(trie_links(nodes.select("fp"), budget))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = stash(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"),
                   "fingerprint-groups")
    return prints.join(labels, "fp")


def near_groups(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row.

    component_id is the smallest doc_id that a chain of fingerprints, each within
    ``budget`` bits of the next, leads to. Equal fingerprints are one node, so copies
    cost nothing; null ids are never the smallest unless a group has no other, and null
    and empty texts have fingerprint zero, linked like any other. An empty table gives no
    rows. Other columns are not used.
    """
    return _labelled(docs, budget, shingle, False).select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, that stay if one document of each group does.

    That is the document of the smallest doc_id. Rows of one doc_id and group are one
    document and stay or go together; a row that shares its id with a document of another
    group is judged on its own. A group without any id keeps one row, that of the
    smallest MD5 of its text.
    """
    found = _labelled(docs, budget, shingle, True)
    least = found.where("component_id IS NULL").groupBy("root").agg(F.min("digest").alias("least"))
    known = found.join(least, "root", "left")
    gone = known.where(
        F.when(F.col("component_id").isNull(), F.col("digest") != F.col("least"))
        .otherwise(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
    gone = stash(gone.select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_text")).distinct(),
                 "near-copies")
    text = digest(F.coalesce("text", F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (text == F.col("g_text"))
    kept = docs.join(gone, same, "left_anti")
    # Rows without an id that are left have one text a group, in as many copies as there are.
    nameless = kept.where("doc_id IS NULL")
    one = nameless.withColumn(_TEXT, digest(F.coalesce("text", F.lit("")))).dropDuplicates([_TEXT]).drop(_TEXT)
    return kept.where("doc_id IS NOT NULL").unionByName(one)


_TEXT = "_md5_of_the_text_of_a_nameless_row"
