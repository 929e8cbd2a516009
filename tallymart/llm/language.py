"""Language identification: family first, then one-versus-one machines within it.

Texts become hashed character n-grams. Linear support vector machines, one per
family, name the family; within it one machine per pair of languages votes. The
machines are fitted on a bounded sample of labelled rows, each in a task of its
own; every text is then judged in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

# ISO 639-1 codes by family. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"), "celtic": ("br", "cy", "ga", "gd"), "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"), "turkic": ("az", "kk", "tr", "uz"),
}
UNDETERMINED = "und"
DIMENSIONS = 1 << 13
#: Rows that a family machine is fitted on; at least one of every language.
MACHINE_ROWS = 6_400


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


def features(text: str, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values, of unit length, of hashed 1- to 4-byte grams of the whole text.

    A value is the square root of the gram's share, which keeps common grams from
    drowning the rest.
    """
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    counts = np.zeros(dimensions, np.int64)
    gram = data
    for n in range(1, 5):
        if n > 1:
            if len(data) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | data[n - 1:]
        hashed = (gram * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519)
        counts += np.bincount(hashed >> shift, minlength=dimensions)
    index = np.flatnonzero(counts)
    values = np.sqrt(counts[index])
    return index.astype(np.int32), (values / np.sqrt(counts.sum())).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; y is 1 or -1.

    Both classes weigh the same, however many rows they have. Accelerated gradient
    steps on the whole (bounded) sample, so the same rows always give the same machine.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # The weights are a sum of rows; the steps are taken on the rows' coefficients.
    products = (x @ x.T).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    step = 1.0 / (2.0 * 2.0 + penalty)
    c = ahead = np.zeros(len(x))
    for k in range(rounds):
        slack = np.maximum(0.0, 1.0 - y * (products @ ahead))
        moved = ahead - step * (penalty * ahead - 2.0 * weight * y * slack)
        ahead = moved + k / (k + 3.0) * (moved - c)
        c = moved
    # Some columns at a time: a whole copy in double precision is the largest thing in memory.
    return np.concatenate([x[:, i:i + 512].T.astype(np.float64) @ c for i in range(0, x.shape[1], 512)])


class LanguageModel:
    """Fitted machines: by family name, and by pair of languages."""

    def __init__(self, langs: list[str], families: dict[str, np.ndarray],
                 pairs: dict[tuple[str, str], np.ndarray]):
        self.families, self.pairs = families, pairs
        self.profiles: Profiles | None = None
        self.members: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.members.setdefault(family_of(lang), []).append(lang)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.members or not has_letter(text):
            return UNDETERMINED, 0.0
        index, values = features(text)

        def margin(w: np.ndarray) -> float:
            return float(w[index] @ values + w[-1])

        sure = 1.0
        family = next(iter(self.members))
        if len(self.members) > 1:
            scores = {name: margin(self.families[name]) for name in self.members}
            family = max(scores, key=lambda name: (scores[name], name))
            sure = _certainty(scores[family])
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], sure
        votes, gains = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for pair in combinations(langs, 2):
            m = margin(self.pairs[pair])
            winner, loser = pair if m >= 0 else pair[::-1]
            votes[winner] += 1
            gains[winner] += abs(m)
            gains[loser] -= abs(m)
        best = max(langs, key=lambda name: (votes[name], gains[name], name))
        return best, sure * _certainty(gains[best] / (len(langs) - 1))


def _certainty(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-3.0 * np.clip(margin, -10, 10))))


def training_sample(docs: DataFrame, rows_per_lang: int = 400) -> DataFrame:
    """lang, text and place (from 1) of at most ``rows_per_lang`` labelled rows of every language.

    Rows are taken by a hash of the id, however many languages there are.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    share = F.pmod(order, F.lit(1 << 20)) / float(1 << 20)
    # Twice the wanted number by a share of the hash, then the exact first ones of few rows.
    sizes = F.broadcast(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")))
    near = labelled.join(sizes, "lang").where(share < 2.0 * rows_per_lang / F.col("_n"))
    first = Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text"), "text")
    return near.withColumn("_r", F.row_number().over(first)).where(
        F.col("_r") <= rows_per_lang).select("lang", "text", F.col("_r").alias("place"))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("place"),
             pa.array([i.tobytes() for i, _ in found], pa.binary()),
             pa.array([v.tobytes() for _, v in found], pa.binary())], ["lang", "place", "at", "value"])


def _fit_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["lang", "at"])
    x = np.zeros((len(group), DIMENSIONS), np.float32)
    for row, at, value in zip(x, group["at"], group["value"]):
        row[np.frombuffer(at, np.int32)] = np.frombuffer(value, np.float32)
    weights = fit_machine(x, group["side"].to_numpy(np.float64))
    return pd.DataFrame({"machine": [group["machine"].iloc[0]], "weights": [weights.tobytes()]})


def fit(docs: DataFrame, rows_per_lang: int = 400) -> LanguageModel:
    """Fit on ``docs`` with text and lang; the model's size depends on the languages only.

    Every language of the sample is learned. A family machine sees all languages, and
    fewer rows of each from 16 languages on, so that its task stays bounded.
    """
    drawn = training_sample(docs, rows_per_lang)
    langs = sorted(r[0] for r in drawn.select("lang").distinct().collect())
    sample = drawn.mapInArrow(_featured, "lang string, place int, at binary, value binary")
    families = sorted({family_of(lang) for lang in langs})
    each = max(1, MACHINE_ROWS // max(1, len(langs)))
    tasks = []  # (machine, lang, side, rows of the language)
    if len(families) > 1:
        tasks += [(f"family {name}", lang, 1 if family_of(lang) == name else -1, each)
                  for name in families for lang in langs]
    pairs = [p for p in combinations(langs, 2) if family_of(p[0]) == family_of(p[1])]
    for a, b in pairs:
        tasks += [(f"pair {a} {b}", a, 1, rows_per_lang), (f"pair {a} {b}", b, -1, rows_per_lang)]
    if not tasks:
        return LanguageModel(langs, {}, {})
    plan = docs.sparkSession.createDataFrame(
        tasks, "machine string, lang string, side int, most int")
    fitted = sample.join(F.broadcast(plan), "lang").where("place <= most").groupBy("machine").applyInPandas(
        _fit_group, "machine string, weights binary").collect()
    machines = {r["machine"]: np.frombuffer(r["weights"]) for r in fitted}
    return LanguageModel(langs, {f: machines[f"family {f}"] for f in families if len(families) > 1},
                         {(a, b): machines[f"pair {a} {b}"] for a, b in pairs})


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (0 to 1).

    A text that is null or has no letter gets ``und`` and 0, and so does every text if
    nothing was learned. Own columns named lang_pred or score are replaced. A model with
    profiles also gives lang_known, the languages whose own texts are hardly less odd: a
    second Python step over the same texts would take a second worker for every task.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if model.profiles:
        added.append(T.StructField("lang_known", T.ArrayType(T.StringType())))
    docs = docs.drop(*[f.name for f in added])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [model.predict(t.as_py()) for t in texts]
            columns = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            if model.profiles:
                columns.append(pa.array([model.profiles.known(t.as_py()) for t in texts], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *added]))


_LEEWAY = 1.0
_NO_LETTERS = re.compile(r"[\W\d_]+")


def _letter_features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Gram indices and shares of the text's letters, and how many bytes they are."""
    letters = _NO_LETTERS.sub(" ", text).strip()
    index, values = features(letters)
    return index, np.square(values, dtype=np.float64), len(letters.encode())


def _slack(size: int | np.ndarray) -> float | np.ndarray:
    """How far above the bar a text of so many bytes may be: few grams say little."""
    return _LEEWAY + 4.0 / np.sqrt(np.maximum(size, 1))


class Profiles:
    """How common each gram is in each learned language, and how odd its texts are.

    A text's oddness in a language is the mean of -log(gram's share) over the text's
    grams; the bar of a language is what 99 of 100 of its labelled texts stay below,
    each judged by the others of the sample.
    """

    def __init__(self, langs: list[str], costs: np.ndarray, bars: np.ndarray):
        self.langs, self.costs, self.bars = langs, costs, bars

    def known(self, text: str | None) -> list[str]:
        """The languages whose own texts are hardly less odd than the text; none without a letter."""
        if not has_letter(text):
            return []
        index, shares, size = _letter_features(text)
        slack = _slack(size)
        return [lang for lang, costs, bar in zip(self.langs, self.costs, self.bars)
                if costs[index] @ shares <= bar + slack]


def _profile(group: pd.DataFrame) -> pd.DataFrame:
    found = [f for f in map(_letter_features, group["text"]) if f[2]]
    total, rest = np.zeros(DIMENSIONS), 1.0 / DIMENSIONS  # half a text's worth of even shares
    for index, shares, _ in found:
        total[index] += shares
    odd = []
    for index, shares, size in found:
        others = (total[index] - shares + rest / 2) / (len(found) - 0.5)
        odd.append(-shares @ np.log(np.maximum(others, rest / 2 / len(found))) - _slack(size) + _LEEWAY)
    costs = -np.log((total + rest / 2) / (len(found) + 0.5))
    bar = float(np.percentile(odd, 99)) if odd else -np.inf
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "bar": [bar],
                         "costs": [costs.astype(np.float32).tobytes()]})


def fit_profiles(docs: DataFrame, rows_per_lang: int = 400) -> Profiles:
    """Profiles of all languages in the training sample."""
    rows = training_sample(docs, rows_per_lang).select("lang", "text").groupBy(
        "lang").applyInPandas(_profile, "lang string, bar double, costs binary").collect()
    rows.sort(key=lambda r: r["lang"])
    costs = np.array([np.frombuffer(r["costs"], np.float32) for r in rows]).reshape(-1, DIMENSIONS)
    return Profiles([r["lang"] for r in rows], costs, np.array([r["bar"] for r in rows]))


def keep_known(judged: DataFrame) -> DataFrame:
    """Rows of ``identify`` by a model with profiles whose text looks like one of the language it was given."""
    return judged.where(F.array_contains("lang_known", F.col("lang_pred"))).drop("lang_known")
