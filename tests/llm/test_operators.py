from __future__ import annotations

import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from tallymart.llm import (  # noqa: E402
    decontaminate, exact, language, lines, mixing, queries, scoring, simhash, substrings, suffixes,
    tokens)
from tallymart.session import new_scratch_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string"
LONG = " ".join(f"word{i % 977}x{i // 7}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (0, f"Start here {PASSAGE} and an end", "en", "a", 1, "x"),
    (1, f"Another {PASSAGE} altogether", "en", "a", 1, None),
    (2, LONG, "en", "b", 1, "x"), (3, LONG + " more", None, "b", None, "x"),
    (4, None, "fr", None, 1, "x"), (5, "", "fr", None, 1, "x"), (6, "  \n\t ", "de", "a", 1, "x"),
    (7, "One line that repeats often\nshort\none LINE that repeats often ", "de", "a", 1, "x"),
    (8, "one line that repeats often", "de", "a", 1, "x"),
    (9, "  One line that repeats often\nother", "de", "a", 1, "x"),
    (10, "one line  that repeats often", "de", "a", 1, "x"),
    (11, "é ü  <|endoftext|> a\n b", "fr", "c", 1, "x"), (12, "a b", "es", "c", 1, "x"),
]
PLAIN = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    queries.small_batches(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """A repeated row, a null id."""
    return spark.createDataFrame([*ROWS, ROWS[0], (None, PASSAGE, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_mixture_stays_within_a_block_and_keeps_all_rows(spark, docs, odd, empty):
    quotas = spark.createDataFrame([("a", 5), ("b", 3), (None, 1), ("c", 2)], "source string, quota long")
    slots = {r["phase"]: r for r in mixing.timetable(quotas).collect()}
    assert sorted(slots) == list(range(11))
    for t in range(1, 12):
        for name, q in (("a", 5), ("b", 3), (None, 1), ("c", 2)):
            had = sum(slots[i]["source"] == name for i in range(t))
            assert abs(had - t * q / 11) < 1
    mixed = mixing.mix_sources(odd, block_docs=2).collect()
    assert len(mixed) == len(ROWS) + 2
    assert len({r["mix_order"] for r in mixed}) == len(mixed)
    assert mixing.mix_sources(empty).count() == 0
    given = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    got = {r["source"]: r["quota"] for r in mixing.target_quotas(docs, given).collect()}
    assert got == {"a": 3, "b": 1, "c": 0, None: 0}


def test_scores_prefer_the_target(spark, docs, odd, empty):
    targets = spark.createDataFrame([(0,), (0,), (None,)], "doc_id long")
    got = by_id(scoring.score_documents(odd, targets), "n_words", "score")
    assert got[4] == (0, None) and got[0][1] < got[2][1] and got[1][1] < got[2][1]
    assert scoring.score_documents(empty, targets).count() == 0
    assert scoring.score_documents(docs, targets.where("false")).count() == len(ROWS)


def test_simhash_groups(docs, odd, empty):
    got = by_id(simhash.near_groups(docs), "fp", "component_id")
    want = brute.near_groups(PLAIN)
    assert {i: (f"{fp % (1 << 64):016x}", c) for i, (fp, c) in got.items()} == want
    assert simhash.near_groups(odd).count() == len(ROWS) + 2 and simhash.near_groups(empty).count() == 0


def test_trie_walk_finds_all_near_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30), dtype=np.uint64)
    a = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel()]))
    found = {(i, j) for x, y in simhash._walk(a, a, 0, 0, 2, leaf=16) for i, j in zip(x, y)}
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 2
    assert found == set(zip(*map(list, np.nonzero(near))))


def test_lines(docs, odd, empty):
    got = by_id(lines.dedup_lines(docs), "n_lines", "n_dropped", "kept_text")
    assert got[7] == (3, 2, "short") and got[8] == (1, 1, "") and got[9] == (2, 0, ROWS[9][1])
    assert got[4] == got[5] == (1, 0, "") and got[10] == (1, 0, ROWS[10][1])
    assert lines.dedup_lines(odd).count() == len(ROWS) + 2 and lines.dedup_lines(empty).count() == 0


def test_exact(docs, odd, empty):
    got = by_id(exact.exact_groups(docs), "keep_id", "group_size", "kept")
    assert got[4] == (4, 2, True) and got[5] == (4, 2, False) and got[6] == (6, 1, True)
    assert got[10] == (8, 2, False)
    twice = [r for r in exact.exact_groups(odd).collect() if r["doc_id"] == 0]
    assert len(twice) == 2 and all(r["group_size"] == 2 and r["kept"] for r in twice)
    assert exact.exact_groups(empty).count() == 0


def test_fuse_filter_has_no_false_no():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 5000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        built = exact.BinaryFuse.from_bytes(exact.BinaryFuse.build(keys).to_bytes())
        assert built.has(keys).all()
        assert built.has(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.02


def test_token_files_round_trip(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    folder = new_scratch_path(spark, "tokens")
    tokens.write_tokens(docs, folder, path, segment_ids=50)
    got = by_id(tokens.read_documents(spark, folder), "start", "n_tokens", "ids_crc32")
    at = 0
    for i, text in PLAIN:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for table, n in ((odd, len(ROWS) + 2), (empty, 0)):
        folder = new_scratch_path(spark, "tokens")
        tokens.write_tokens(table, folder, path)
        assert tokens.read_documents(spark, folder).count() == n


def test_elias_fano_select():
    values = np.sort(np.random.default_rng(3).integers(0, 10 ** 6, 1000))
    for v in (values, values[:1], values[:0], np.zeros(5, int), np.arange(200)):
        code = tokens.EliasFano.encode(v)
        assert (code.values() == v).all() and [code.select(i) for i in range(len(v))] == list(v)


def test_language(spark, docs, odd, empty):
    model = language.fit(docs)
    got = by_id(language.identify(docs, model), "lang_pred", "score", "bucket")
    assert got[4][:2] == got[5][:2] == got[6][:2] == ("und", 0.0)
    assert all(0 <= s <= 1 and p in ("de", "en", "es", "fr", "und") for p, s, _ in got.values())
    none = language.fit(empty)
    assert language.identify(odd, none).where("lang_pred = 'und'").count() == len(ROWS) + 2
    assert language.identify(empty, model).count() == 0


def test_contaminated(spark, docs, odd, empty):
    items = spark.createDataFrame(
        [(1, PASSAGE.upper()), (2, "start HERE"), (3, None), (4, "not there at all, or is it"),
         (5, " ".join(PASSAGE.split()[:20] + ["other"]))], "item_id long, text string")
    found = decontaminate.contaminated(docs, items, items_a_pass=2)
    got = {(r[0], r[1]): (r[2], r[3]) for r in found.collect()}
    assert got == brute.containment(PLAIN, [(r[0], r[1]) for r in items.collect()]) | {(0, 2): (1, 1)}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0


def test_suffixes(docs, odd, empty):
    got = by_id(suffixes.dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.window_dedup(PLAIN, lambda t: (t or "").encode(), 50, bytes)
    assert got[3][1] > 0 and suffixes.dedup_bytes(odd).count() == len(ROWS) + 2
    assert suffixes.dedup_bytes(empty).count() == 0


def test_substrings(docs, odd, empty):
    got = by_id(substrings.dedup_windows(docs), "n_words", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.window_dedup(PLAIN, brute.words, 50, b" ".join)
    assert substrings.dedup_windows(odd).count() == len(ROWS) + 2
    assert substrings.dedup_windows(empty).count() == 0


def test_suffix_columns_travel_whole():
    for columns in ([[0, 0, 0], [7, 0, 1 << 47]], [[3, 3, 1 << 63], [0, 0, 0]], [[], []]):
        columns = [np.array(c, np.uint64) for c in columns]
        back = suffixes._expand(suffixes._squeeze(columns), 2)
        assert [c.tolist() for c in back] == [c.tolist() for c in columns]


def test_suffix_rows_are_told_apart_alike_packed_or_not():
    rows = np.random.default_rng(3).integers(0, 5, (3, 400))
    rows[0] += 1 << 20
    first, which = suffixes._distinct(list(rows))
    packed, same = suffixes._distinct(list(rows), [21, 21, 21])
    assert (which == same).all() and (rows[:, first] == rows[:, packed]).all()
    assert suffixes._packed(list(rows), [22, 22, 22]) is None


def test_nine_bytes_are_told_apart_alike_with_and_without_places():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    for letters in (1, 3, 90, 250):
        texts = [rng.integers(1, letters + 1, 300).astype(np.uint8).tobytes() for _ in range(4)]
        docs = pa.table({"digest": pa.array([bytes([i]) for i in range(4)]), "doc_id": pa.array(range(4)),
                         "text": pa.array(texts, pa.binary())})
        unit = suffixes._Stretches(docs)
        keys, which = unit.nine(True)
        same, twice = unit.nine(False)
        assert all((a == b).all() for a, b in zip(keys, same))
        assert ((np.bincount(which) > 1) == twice).all()
        data = unit.data.tobytes()
        for place, k in zip(unit.sample[:200].tolist(), which.tolist()):
            assert int(keys[0][k]).to_bytes(8, "big") + bytes([int(keys[1][k])]) == data[place:place + 9]


def test_anchors_do_not_depend_on_the_strips(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[1000:1400] = data[3000:3400]
    whole = suffixes._anchors(data)
    monkeypatch.setattr(suffixes, "_STRIP", 128)
    for a, b in zip(whole, suffixes._anchors(data)):
        assert (a == b).all()


def test_a_full_encoder_gives_the_same_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [t or "" for _, t in PLAIN] * 2 + ["new words here", "here new words"]
    for most in (0, 5, 10 ** 6):
        encoder = tokens.WordwiseEncoder(path, most)
        for _ in range(2):
            ids, ends = encoder.encode(pa.array(texts))
            got = [ids[a:b].tolist() for a, b in zip(np.append(0, ends[:-1]), ends)]
            assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
