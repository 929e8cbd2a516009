"""Line dedup over levelled sorted runs of line digests.

``LineRuns`` keeps the digests seen so far as tables bucketed and sorted by line. A new batch is
anti-joined with every run (a merge of two sorted sides), and what is new in it
becomes a run of level 0; when a level has ``fanout`` runs, they are merged into
one of the next level. Lines are compared by the 128-bit digest of their key.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymart.llm.common import LOWER, UPPER, WHITE, digest, id_ranges, in_range, whole_texts
from tallymart.session import stash, stash_bucketed


class LineRuns:
    """Digests seen so far, each with the doc_id it was first admitted from."""

    def __init__(self, fanout: int = 3):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def admit(self, batch: DataFrame) -> None:
        """Add the digests of ``batch`` (line, keeper; one row a line) that no run has."""
        fresh = batch
        for run in self.runs:
            fresh = fresh.join(run, "line", "left_anti")
        self._add(0, fresh)
        for level in range(len(self.levels)):  # compaction, smallest level first
            if len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                merged = full[0]
                for run in full[1:]:
                    merged = merged.unionByName(run)
                self._add(level + 1, merged)

    def _add(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        # Bucketed and sorted by line: a batch grouped by line meets its run bucket by bucket,
        # and only the batch is ever shuffled.
        self.levels[level].append(stash_bucketed(rows, f"line_run_{level}", "line", sort="line"))

    def all(self) -> DataFrame | None:
        merged = None
        for run in self.runs:
            merged = run if merged is None else merged.unionByName(run)
        return merged


def line_key(line: Column) -> Column:
    """The line stripped, with A-Z lowered; lower() does that for a line of ASCII alone."""
    stripped = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)).otherwise(
        F.translate(stripped, UPPER, LOWER))


def _held_by(held: DataFrame, min_docs: int) -> DataFrame:
    """The lines of at least ``min_docs`` different doc_ids, null being one of them.

    Distinct (line, doc_id) come first, spread over all tasks however common a line is;
    then a line is counted with partial sums.
    """
    once = held.select("line", "doc_id").distinct()
    return once.groupBy("line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3,
                batches: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row.

    A line whose key has ``min_chars`` code points and is found under ``min_docs`` different
    doc_ids (null counts as one) stays only in the largest doc_id that has it; batches are taken from the largest
    doc_id down, so that the first to admit a line keeps it. A null text is one
    empty line. Rows with one doc_id are one document: they count once, and keep or lose a
    line together.
    A null doc_id sorts below all others. Other columns are not used.
    """
    # A row is known by its doc_id and a hash of its text: rows that share both are the
    # same lines, and a place that is told twice is still one place.
    texts = whole_texts(docs).withColumn("_text", F.xxhash64("text"))
    split = texts.select("doc_id", "_text", F.split("text", "\n", -1).alias("lines"))
    keys = F.filter(
        F.transform("lines", lambda line, i: F.struct(line_key(line).alias("key"), i.alias("pos"))),
        lambda x: F.char_length(x["key"]) >= min_chars)
    # Sorted by key, a line's first place in its row is the one after another key.
    ordered = split.select("doc_id", "_text", F.sort_array(keys).alias("_keys"))
    held = ordered.select("doc_id", "_text", F.explode(F.transform("_keys", lambda x, i: F.struct(
        digest(x["key"]).alias("line"), x["pos"].alias("pos"),
        ((i == 0) | (F.get("_keys", i - 1)["key"] != x["key"])).alias("first")))).alias("_l")
    ).select("doc_id", "_text", "_l.line", "_l.pos", "_l.first")
    held = stash(held, "lines")
    common = _held_by(held.where("first"), min_docs)
    marks = stash(held.drop("first").join(common.select("line"), "line", "left_semi"), "line-marks")

    runs = LineRuns()
    for bounds in reversed(id_ranges(marks, batches)):
        batch = marks.where(in_range(bounds)).groupBy("line").agg(F.max("doc_id").alias("keeper"))
        runs.admit(batch)
    # A line is kept where it was admitted from; the rest of its marks go.
    kept = runs.all().select("line", F.col("keeper").alias("_k"))
    gone = marks.join(
        kept, (marks["line"] == kept["line"]) & marks["doc_id"].eqNullSafe(kept["_k"]), "left_anti")
    per_row = gone.groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).agg(
        F.collect_list("pos").alias("_gone"))
    # Both sides grow with the documents: a merge join at every size, never a broadcast.
    joined = texts.join(
        per_row.hint("merge"), texts["doc_id"].eqNullSafe(per_row["_d"]) & (texts["_text"] == per_row["_t"]),
        "left").select("doc_id", F.split("text", "\n", -1).alias("lines"), "_gone")

    # array_except hashes, so a row with many lines and many gone costs their sum.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "_gone")
    kept_lines = F.when(F.col("_gone").isNull(), F.col("lines")).otherwise(
        F.transform(places, lambda i: F.get("lines", i)))
    return joined.withColumn("_kept", kept_lines).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("kept_text"))


LINES_SQL = """
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) >= 3),
marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""
