from __future__ import annotations

import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from tallymart.llm import lexical, queries  # noqa: E402
from tallymart.llm.units import WordHashes  # noqa: E402

SCHEMA = "doc_id long, text string, item long, score string, rank int, items int"
ITEMS = [(1, "alpha beta gamma"), (2, "DELTA, delta! w3 é 日本"), (3, None), (4, "nowhere to be seen"),
         (5, ""), (1, "alpha"), (None, "w1 w2 w3 w4 w5 w6")]


def rows() -> list[tuple]:
    rng = random.Random(5)
    common = [f"w{i}" for i in range(60)] + ["alpha", "beta", "gamma", "Delta", "é", "日本"]
    out = [(i, " ".join(rng.choices(common, weights=[1 / (k + 1) for k in range(len(common))],
                                    k=rng.choice((3, 20, 200))))) for i in range(150)]
    out += [(200 + i, "alpha beta beta, gamma.") for i in range(30)]  # ties of one text
    out += [(200, "alpha beta beta, gamma."), (None, "alpha alpha"), (None, None), (301, ""), (302, "?! ..."),
            (303, "alpha " * 9000 + "beta"), (304, "ALPHA\x7fbeta\x00gamma{delta")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    queries.small_batches(spark)
    return spark.createDataFrame([(*r, 1, "s", 2, 3) for r in rows()], SCHEMA).repartition(3)


@pytest.mark.parametrize("k, passes", [(50, 500), (3, 2)])
def test_ranking_equals_scoring_everything(spark, docs, k, passes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical.search(docs, items, k=k, items_a_pass=passes)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(brute.search(rows(), ITEMS, k), key=repr)


def test_nothing_to_search(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.where("false"), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0
    assert lexical.search(docs, items.where("item_id in (3, 4, 5)")).columns == [
        "item_id", "rank", "doc_id", "score"]


def test_bounds_are_never_below_the_score():
    known, rng = WordHashes(), random.Random(6)
    texts = [[b"t%d" % rng.randrange(400) for _ in range(rng.choice((5, 80, 900)))] for _ in range(40)]
    queries_ = lexical.Queries.of([{"item": q, "terms": sorted({f"t{rng.randrange(500)}" for _ in range(9)}),
                                    "weights": list(range(100, 1000, 100))[:9]} for q in range(6)])
    for q in range(6):
        queries_.weights[q] = queries_.weights[q][:len(queries_.columns[q])]
    n_terms = sum(map(len, texts))
    for bits in (64, 1 << 14):  # a signature much too full is as valid
        block = lexical._Block(bits)
        for i, terms in enumerate(texts):
            block.add(i, len(terms), *lexical._entries(Counter(terms), known))
        row = block.row()
        slices = np.frombuffer(row["slices"], np.uint8).reshape(bits, -1)
        bounds = list(lexical._bounds(queries_, bits, row["sizes"], slices, len(texts), n_terms))
        for q, bound in enumerate(bounds):
            for i, terms in enumerate(texts):
                m = lexical._length(len(terms), len(texts), n_terms)
                score = sum(int(w) * lexical._share(terms.count(queries_.terms[c]), m)
                            for c, w in zip(queries_.columns[q], queries_.weights[q]))
                assert bound[i] >= score
                if bits > 64 and len(terms) == 5:
                    assert bound[i] == score
