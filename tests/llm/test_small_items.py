from __future__ import annotations

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402

import brute  # noqa: E402
from tallymart.llm import decontaminate  # noqa: E402


def test_items_just_above_a_shingle_are_found_in_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    items, docs = [], []
    for n in range(1200):
        size, at = 5 + n % 10, rng.choice([0, 0, rng.randrange(2900)])
        text = words[at:at + 100]
        item = text[rng.randrange(4):][:size]
        if n % 3 == 2 and size >= 10:
            item[-1] = "other"  # 1 shingle of at least 6 is not there
        docs.append((n, " ".join(text)))
        items.append((n, " ".join(item)))
        rng.shuffle(words)
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"))
    got = {(r[0], r[1]): (r[2], r[3]) for r in found.collect()}
    assert got == brute.containment(docs, items)
    assert len(got) >= 1200


def test_few_items_take_a_small_table():
    rng = random.Random(7)
    items = [(n, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(30))) for n in range(20)]
    index = decontaminate.ItemIndex(items, 0.8)
    # 64 tables for 20 items; each once had 65,536 places.
    assert all(table[0].size <= decontaminate.HASHES * 1024 for table in index.tables.values())
    # No value of an item is ruled out by its table.
    for size, (_, mins) in index.partitions.items():
        maybe, shift = index.tables[size][:2]
        assert all(maybe[j][mins[:, j] >> shift].all() for j in range(decontaminate.HASHES))
    assert decontaminate.WORDS_KNOWN <= 100_000


def test_least_values_of_large_windows_are_told_apart():
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10 ** 7)}" for _ in range(n))
    items = [(n, text(30 << n % 5)) for n in range(100)]
    index = decontaminate.ItemIndex(items, 0.8)
    known = decontaminate._WordHashes()
    windows = [decontaminate._hashes(decontaminate.words_of(text(1500).encode()), known) for _ in range(30)]
    for size in index.sizes:
        maybe, shift = index.tables[size][:2]
        least = np.stack([(h[:2 * size, None] * decontaminate._TIMES + decontaminate._PLUS).min(axis=0) for h in windows])
        passed = np.mean([maybe[j][(least[:, j] * decontaminate._SPREAD) >> shift] for j in range(decontaminate.HASHES)])
        assert passed < 0.1  # by their first bits alone 0.49 to 0.99 passed
    assert not index.candidates(windows)
    held = [decontaminate._hashes(decontaminate.words_of(f"{text(200)} {t} {text(200)}".encode()), known) for _, t in items]
    assert {(n, n) for n in range(100)} <= index.candidates(held)
