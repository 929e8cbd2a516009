from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from tallymart.llm import lines, queries  # noqa: E402

LINE = "a line of more than twenty letters"


def test_repeated_rows_are_one_document(spark):
    """Against brute force: two ids are not three documents, however often they are repeated."""
    queries.small_batches(spark)
    rows = [(1, LINE), (1, LINE), (2, f" {LINE.upper()} \nshort"), (3, "another common line, in three ids"),
            (4, "another common line, in three ids\nx"), (None, "Another common line, in three ids"),
            (None, "another common line, in three ids"), (5, None), (6, ""), (7, "\n\n"),
            (8, "ÀÉ a line that two documents have ÀÉ"), (9, "ÀÉ A LINE that two documents have ÀÉ"),
            (9, "àé a line that two documents have àé")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, pos int, line string")
    got = sorted((tuple(r) for r in lines.dedup_lines(docs).collect()), key=repr)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute.line_dedup(rows))), key=repr)
    assert got == want
    assert sum(w[2] for w in want) == 3  # ids 3 and None twice lose the line that 4 keeps
