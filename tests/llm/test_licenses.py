from __future__ import annotations

import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from tallymart.llm import licenses, queries  # noqa: E402
from tallymart.llm.license_rules import BASE, build_rules  # noqa: E402

TEXTS = [
    "Licensed under CC BY-NC 4.0.\nMore", "licensed under the GNU General Public License, version 3.",
    "All rights reserved. ALL RIGHTS RESERVED", "Licensed under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: MIT", "gpl-2.0-or-later and LGPL v2.1 or GNU Lesser General Public License",
    "Copyright (c) 2019 2020 Someone; general public license 2.1", "cc by cc by cc-by 4.0", "all rights", "",
    None, " \n\t", "é general  public_license É", "MIT License " * 3000, "no licence at all", "cc\x7fby\x00",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
ROWS = [*enumerate(TEXTS), (0, TEXTS[0]), (None, TEXTS[1])]


def scanned(spark, rows):
    queries.small_batches(spark)
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows],
                                 "doc_id long, text string, n_words int, found string, places string")
    return licenses.scan_licenses(docs)


def test_places_and_labels(spark):
    got = {}
    for r in licenses.license_digest(scanned(spark, ROWS)).collect():
        got.setdefault(r["doc_id"], r)
    for i, text in ROWS:
        n_words, places = brute.license_places(text, BASE)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n_words, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base))
        assert base <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        assert (r["score"] == 0) == (r["labels"] == "")
    labels = {i: got[i]["labels"].split(",") for i in range(len(TEXTS))}
    assert labels[0] == ["cc-by", "cc-by-nc-4.0"] and labels[1] == ["gpl", "gpl-3.0"]
    assert labels[3] == ["apache-2.0"] and labels[4] == ["mit"] == labels[16] == labels[13]
    assert "gpl-2.0-or-later" in labels[5] and "lgpl-2.1" in labels[5] and "gpl-2.0" not in labels[5]
    assert labels[14] == [""] and labels[8] == [""]
    assert scanned(spark, ROWS).count() == len(ROWS) and scanned(spark, ROWS[:1]).where("false").count() == 0


def test_no_documents(spark):
    queries.small_batches(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.license_digest(licenses.scan_licenses(none)).count() == 0


def test_keywords_never_hide_a_detection():
    rules = build_rules()
    assert len(rules) > 500
    gated, plain = licenses.Scanner(rules, BASE), licenses.Scanner(rules, BASE, gated=False)
    rng = random.Random(7)
    # Texts that the rules like: the patterns themselves, one alternative of each choice.
    made = []
    for rule in rng.sample(rules, 200):
        text = re.sub(r"\(\?![^)]*\)", "", rule.pattern)
        text = re.sub(r"\[[^\]]*\]\+?", "s", text).replace("(?:", "(")
        while "(" in text:
            text = re.sub(r"\(([^()|]*)(?:\|[^()]*)?\)(\?|\+|\{0,\d+\})?",
                          lambda m: m[1] if not m[2] or rng.random() < 0.7 else "", text)
        made.append(text.split("|")[0].replace("?", ""))
    texts = [t for t in TEXTS if t] + [" x ".join(rng.sample(made, 4)) for _ in range(60)]
    hits = 0
    for text in texts:
        words = licenses.folded_words(text.encode())
        assert gated.scan(words) == plain.scan(words)
        hits += len(gated.scan(words)[1])
    assert hits > 100


def test_suppression_equals_all_pairs():
    rng = random.Random(8)
    kinds = [0, 1, 1, 2, 3, 3]
    for _ in range(200):
        found = []
        for _ in range(rng.randrange(12)):
            start = rng.randrange(12)
            found.append((start, start + rng.randrange(1, 8), rng.randrange(6)))
        got = licenses.suppress({licenses.Detection(*f) for f in found}, kinds)
        assert [tuple(d) for d in got] == brute.suppressed(found, kinds)
