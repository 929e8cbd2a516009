"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re

import xxhash


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def fingerprint(text: str | None) -> int:
    found = [w.lower() for w in words(text)]
    if not found:
        return 0
    shingles = [b" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs: list[tuple]) -> dict:
    """doc_id -> (fingerprint, smallest id of the group), by all pairs and a union-find."""
    prints = [(i, fingerprint(t)) for i, t in docs]
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (f"{f:016x}", find(i)) for i, f in prints}


def language_model(docs: list[tuple], targets: set, smoothing: float = 0.1) -> list[tuple]:
    """(n_words, target_loss, background_loss) of each row, by dictionaries of bigrams."""
    import math
    from collections import Counter

    split = [["<s>", *words(t)] for _, t in docs]
    vocabulary = {w for row in split for w in row[1:]}

    def model(rows):
        pairs = Counter(p for row in rows for p in zip(row, row[1:]))
        firsts = Counter(w for row in rows for w in row[:-1])
        return lambda v, w: -math.log((pairs[v, w] + smoothing) / (firsts[v] + smoothing * len(vocabulary)))
    losses = (model([r for (i, _), r in zip(docs, split) if i is not None and i in targets]), model(split))
    return [(len(row) - 1, *((sum(loss(*p) for p in zip(row, row[1:])) / (len(row) - 1)) if row[1:] else None
                             for loss in losses)) for row in split]


def line_dedup(docs: list[tuple], least_chars: int = 20, least_docs: int = 3) -> list[tuple]:
    """(n_lines, n_dropped, kept text) of each row; None sorts below all doc_ids."""
    def key(line):
        return lower_ascii(line.strip(" \t\n\x0b\x0c\r"))
    holders: dict = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders[key(line)]
            if len(key(line)) < least_chars or len(held) < least_docs or i == max(
                    held, key=lambda x: (x is not None, x or 0)):
                kept.append(line)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def kept_of_groups(docs: list[tuple]) -> list[tuple]:
    """Rows that stay if one document of each group of near copies does."""
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if group[i] != group[j] and (a ^ b).bit_count() <= 2:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for g in dict.fromkeys(group):
        rows = [row for row, h in zip(docs, group) if h == g]
        ids = [i for i, _ in rows if i is not None]
        if ids:
            out += [row for row in rows if row[0] == min(ids)]
        else:
            out.append(min(rows, key=lambda row: hashlib.md5((row[1] or "").encode()).digest()))
    return out


def window_dedup(docs: list[tuple], parts_of, width: int, join) -> dict:
    """doc_id -> (parts, removed, runs, sha256 of the rest), judged window by window."""
    owner: dict = {}
    split = {i: parts_of(t) for i, t in docs}
    for i in sorted(split):
        p = split[i]
        for k in range(len(p) - width + 1):
            owner.setdefault(tuple(p[k:k + width]) if isinstance(p, list) else p[k:k + width], i)
    out = {}
    for i, p in split.items():
        gone = [False] * len(p)
        for k in range(len(p) - width + 1):
            key = tuple(p[k:k + width]) if isinstance(p, list) else p[k:k + width]
            if owner[key] < i:
                gone[k:k + width] = [True] * width
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        rest = join([x for x, g in zip(p, gone) if not g])
        out[i] = (len(p), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def containment(docs: list[tuple], items: list[tuple], least: float = 0.8) -> dict:
    def shingles(text):
        w = re.sub(r"[\x00-\x20!-/:-@\[-`{-\x7f]", " ", text or "")
        w = re.sub("[A-Z]", lambda m: m[0].lower(), w).split(" ")
        w = [x for x in w if x]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    out = {}
    for i, t in docs:
        have = shingles(t)
        for k, item in items:
            want = shingles(item)
            if want and len(want & have) >= least * len(want):
                out[i, k] = len(want & have), len(want)
    return out


_FOLD = {chr(k): chr(k + 32) for k in range(65, 91)}


def lower_ascii(text: str) -> str:
    return "".join(_FOLD.get(c, c) for c in text)


def search(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """(item_id, rank, doc_id, score), every document scored for every item."""
    import math

    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    split = [(i, [lower_ascii(w) for w in re.findall(pattern, t or "")]) for i, t in docs]
    split = [(i, w) for i, w in split if w]
    n_docs, n_terms = len(split), sum(len(w) for _, w in split)
    out = []
    for item_id, text in items:
        weights = {}
        for term in {lower_ascii(w) for w in re.findall(pattern, text or "")}:
            df = sum(term in w for _, w in split)
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        scored = []
        for i, w in split:
            m = 100 - 50 + 50 * len(w) * n_docs // n_terms
            score = sum(x * (10 ** 9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t, x in weights.items())
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item_id, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return out


def license_places(text: str | None, phrases) -> tuple[int, list[tuple]]:
    """Number of words, and (first word, label) of every place of a phrase."""
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))
    places = [(at, label) for phrase, label in phrases for at in range(len(found))
              if found[at:at + len(phrase.split())] == phrase.split()]
    return len(found), sorted(places)


def suppressed(found: list[tuple], kind_of) -> list[tuple]:
    """(start, end, order) that no better one holds, by all pairs."""
    found = sorted(set(found))

    def beats(a, b):
        inside = a[0] <= b[0] and a[1] >= b[1]
        ka, kb = kind_of[a[2]], kind_of[b[2]]
        return inside and (ka < kb or ka == kb and ((a[0], a[1]) != (b[0], b[1]) or a[2] < b[2]))
    return [b for b in found if not any(beats(a, b) for a in found if a != b)]


def spelling(docs: list[tuple]) -> dict:
    """word -> (form, root, n, n_near, form_n), by all pairs of words."""
    import zlib
    from collections import Counter

    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n[w], len(beside[w]), n[form[w]] if form[w] else None) for w in n}
