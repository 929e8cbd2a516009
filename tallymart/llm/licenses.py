"""Licence scans by ordered signature rules.

A text becomes its words joined by single spaces. The set of its words decides which
rules are tried at all: a rule names words that must all be there. What the rules find
are intervals of words; a detection goes if one of a more trusted class, or of its own
class, holds its whole interval (of equal ones the earlier rule stays).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import text_rows, whole_texts
from tallymart.llm.license_rules import BASE, Rule, build_rules

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
              for c in range(256))
_FOUND = pa.struct([("label", pa.string()), ("class", pa.int32()), ("relevance", pa.float64()),
                    ("first_word", pa.int64()), ("last_word", pa.int64()), ("matched", pa.string())])
_PLACE = pa.struct([("label", pa.string()), ("first_word", pa.int64())])
_SCHEMA = ("doc_id long, n_words long, places array<struct<label string, first_word long>>, "
           "found array<struct<label string, class int, relevance double, first_word long, "
           "last_word long, matched string>>")


class Detection(NamedTuple):
    start: int  # of the text's words joined by spaces, in bytes
    end: int
    order: int  # of the rule


def folded_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and all code points beyond ASCII; only A-Z lowered."""
    return text.translate(_FOLD).split()


def suppress(found: Iterable[Detection], kind_of: Sequence[int]) -> list[Detection]:
    """Detections that no other one of an earlier class, or of their own, holds whole.

    ``kind_of[order]`` is the class of a rule. Within a class the longer one stays, of
    equal intervals the one of the earlier rule. The result is ordered by place.
    """
    kept: list[Detection] = []
    for _, group in groupby(sorted(found, key=lambda d: kind_of[d.order]), lambda d: kind_of[d.order]):
        starts = [d.start for d in kept]
        reach = list(accumulate((d.end for d in kept), max))
        far = -1
        own = []
        for d in sorted(group, key=lambda d: (d.start, -d.end, d.order)):
            before = bisect_right(starts, d.start)
            if d.end > far and (not before or reach[before - 1] < d.end):
                own.append(d)
            far = max(far, d.end)
        kept = sorted(kept + own)
    return kept


class Scanner:
    """Rules ready to run; ``gated=False`` tries every rule on every text."""

    def __init__(self, rules: Sequence[Rule], phrases: Sequence[tuple[str, str]], gated: bool = True):
        self.rules = rules
        self.kinds = [r.kind for r in rules]
        self.gated = gated
        self.compiled = [re.compile(f"(?<= )(?:{r.pattern})(?= )".encode()) for r in rules]
        self.phrases = [(re.compile(f"(?= ({re.escape(p)}) )".encode()), label) for p, label in phrases]
        self.phrase_words = [frozenset(p.encode().split()) for p, _ in phrases]
        keys = [frozenset(k.encode() for k in r.keywords) for r in rules]
        # Rules hang under their longest word, which tends to be the rarest.
        self.by_word: dict[bytes, list[tuple[int, frozenset[bytes]]]] = {}
        for order, words in enumerate(keys):
            if not words:
                raise ValueError(f"a rule without keywords: {rules[order].pattern}")
            self.by_word.setdefault(max(words, key=lambda w: (len(w), w)), []).append((order, words))
        self.first = frozenset(self.by_word)

    def scan(self, words: list[bytes]) -> tuple[list[tuple], list[tuple]]:
        """Places of the phrases, and what is left of the rules' detections, by word."""
        have = set(words)
        tried = [i for i, need in enumerate(self.phrase_words) if need <= have]
        if self.gated:
            orders = [o for w in self.first & have for o, need in self.by_word[w] if need <= have]
        else:
            orders = range(len(self.rules))
        if not tried and not orders:
            return [], []
        line = b" " + b" ".join(words) + b" "
        places = [(m.start(1), self.phrases[i][1]) for i in tried for m in self.phrases[i][0].finditer(line)]
        kept = suppress((Detection(m.start(), m.end(), o) for o in orders
                         for m in self.compiled[o].finditer(line)), self.kinds)
        cuts = sorted({*(p for p, _ in places), *(d.start for d in kept), *(d.end for d in kept)})
        number, at, count = {}, 0, -1
        for cut in cuts:  # the word that starts at a byte, or that ends before it
            count += line.count(b" ", at, cut)
            number[cut], at = count, cut
        return (sorted((number[p], label) for p, label in places),
                [(self.rules[d.order].label, self.rules[d.order].kind, self.rules[d.order].relevance,
                  number[d.start], number[d.end], line[d.start:d.end].decode()) for d in kept])


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] | None = None,
                  phrases: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """doc_id, n_words, places and found for every row of ``docs``; needs doc_id and text.

    ``places`` are all places of the phrases (label, first_word), ``found`` the rules'
    detections after suppression with their words. Words count from 0. Null and empty
    texts have no words and two empty arrays; whole texts are read, whatever their
    length. Every row gives one row, repeated and null doc_ids included; other columns
    are left alone and cannot clash. An empty table gives no rows. Equal detections fall
    to the earlier rule. Nothing is shuffled.
    """
    rules = build_rules() if rules is None else list(rules)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, phrases)
        for ids, texts in text_rows(batches):
            counts, places, found = [], [], []
            for text in texts:
                words = folded_words(text)
                here, left = scanner.scan(words)
                counts.append(len(words))
                places.append([{"label": label, "first_word": at} for at, label in here])
                found.append([dict(zip(_FOUND.names, row)) for row in left])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(places, pa.list_(_PLACE)), pa.array(found, pa.list_(_FOUND))],
                ["doc_id", "n_words", "places", "found"])

    return whole_texts(docs).mapInArrow(compute, _SCHEMA)


def license_digest(scanned: DataFrame, phrase_relevance: float = 0.2) -> DataFrame:
    """One flat row a document: counts and places of the phrases, labels, best relevance.

    first_word and last_word are null without a phrase, the label columns then empty text;
    score is 0 where nothing at all was found.
    """
    alone = F.when(F.size("places") > 0, F.lit(phrase_relevance)).otherwise(F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"),
        F.array_max("places.first_word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("places.label", "found.label")), ",").alias("labels"),
        F.greatest(F.array_max("found.relevance"), alone).alias("score"))
