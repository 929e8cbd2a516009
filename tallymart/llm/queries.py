"""The operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymart.llm import (
    decontaminate, exact, language, lexical, licenses, lines, mixing, scoring, simhash, spelling, substrings,
    suffixes, tokens)
from tallymart.llm.common import LOWER, UPPER, new_scratch_path, table
from tallymart.session import configure

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand long texts to Python a thousand at a time, whatever the session's default is."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select(
        "doc_id", "source", "block", "slot", "target_weight", "mix_order")


def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1")
    return scoring.score_documents(table(spark, folder, "documents"), good)


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def op6_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    files = new_scratch_path(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), files, tokenizer_path())
    return tokens.read_documents(spark, files)


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.fit(docs.where(F.coalesce(~held_out, F.lit(False))))
    judged = language.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"),
                         "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.dedup_bytes(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_windows(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, folder, "documents")))


def op13_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents"))


def _fold_sql() -> str:
    """The two translate() arguments that fold a text the way the operator does."""
    parts = [*range(1, 33), *(c for c in range(33, 128) if not chr(c).isalnum())]
    upper = " || ".join([f"'{UPPER}'", *(f"chr({c})" for c in parts)])
    return f"{upper}, '{LOWER}' || repeat(' ', {len(parts)})"


_BUILD: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_mix_sources": (op1_mix_sources, mixing.MIX_SQL.format(docs="documents") + (
        "SELECT doc_id, source, block, slot, target_weight, mix_order FROM mixed")),
    "op2_lm_scores": (op2_lm_scores, None),
    "op3_simhash": (op3_simhash, None),
    "op4_line_dedup": (op4_line_dedup, lines.LINES_SQL),
    "op5_exact_dedup": (op5_exact_dedup, exact.EXACT_SQL),
    "op6_token_ids": (op6_token_ids, None),
    "op7_language": (op7_language, None),
    "op8_decontaminate": (op8_decontaminate, decontaminate.LEAK_SQL.format(fold=_fold_sql())),
    "op9_suffix_dedup": (op9_suffix_dedup, None),
    "op10_substring_dedup": (op10_substring_dedup, None),
    "op11_lexical_search": (op11_lexical_search, lexical.SEARCH_SQL.format(upper=UPPER, lower=LOWER)),
    "op12_license_scan": (op12_license_scan, None),
    "op13_spelling_groups": (op13_spelling_groups, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build):
        return lambda spark, folder: build(small_batches(spark), folder)
    return {name: bound(build) for name, (build, _) in _BUILD.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _BUILD.items() if sql}
