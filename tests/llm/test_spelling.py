from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from tallymart.llm import queries, spelling  # noqa: E402


def rows() -> list[tuple]:
    rng = random.Random(9)
    stems = ["".join(rng.choices("abcéÀ÷", k=rng.randrange(5, 9))) for _ in range(25)]
    words = list(stems)
    for stem in stems:
        for _ in range(6):
            at = rng.randrange(len(stem))
            words += [stem[:at] + rng.choice("abc") + stem[at + 1:], stem[:at] + stem[at + 1:],
                      stem[:at] + rng.choice("abc") + stem[at:], stem + "a", "b" + stem]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "abcabc" * 500, "abcabc" * 500 + "a", "four", "x"]
    out = [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(
        words, weights=[1 / (1 + k % 17) for k in range(len(words))], k=60))) for i in range(40)]
    out += [(50, ("abcabc" * 500 + "\n") * 4 + ("abcabc" * 500 + "a1") * 3), (51, None), (52, ""), (53, "1 2 ."),
            (None, "aaaaa aaaaaa aaaaa baaaaa"), (0, out[0][1])]
    return out


@pytest.mark.parametrize("group_words", [256, 6])
def test_groups_equal_all_pairs(spark, group_words):
    queries.small_batches(spark)
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows()],
                                 "doc_id long, text string, word string, n int, key int").repartition(3)
    found = spelling.spelling_groups(docs, group_words=group_words).collect()
    want = brute.spelling(rows())
    assert len(found) == len(want) > 60
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == want
    assert any(w[0] and w[0] != w[1] for w in want.values())  # chains of more than one form


def test_no_words(spark):
    queries.small_batches(spark)
    none = spark.createDataFrame([(1, None), (2, "a b c"), (None, "")], "doc_id long, text string")
    assert spelling.spelling_groups(none).count() == 0
    assert spelling.spelling_groups(none.where("false")).columns == [
        "word", "form", "root", "n", "n_near", "form_n"]
