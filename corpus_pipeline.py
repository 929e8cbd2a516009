"""From raw documents to token files: five stages over the operators in tallymart.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymart.llm import decontaminate, language, mixing, simhash, tokens
from tallymart.llm.common import new_scratch_path, stash, table
from tallymart.llm.queries import small_batches, tokenizer_path
from tallymart.session import scratch_scope

#: No stage's work can be said in SQL as a whole (machines, hashes with a seed, a tokenizer).
ORACLE_SQL = None
#: Text that a task of the last stage encodes at a time: executors still hold what the other stages needed.
PIECE_BYTES = 3_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have; others go.

    The machines of op7 name a text's language, from all labelled rows. They always choose
    one of the learned languages, so a text without a letter (or null) goes, and one whose
    letters are clearly odder than those of the named language's own texts. A close relative
    of a learned language can pass. If no row has a label there is nothing to judge by, and
    all stay.
    """
    small_batches(spark)
    model = language.fit(docs)
    if not model.members:
        return docs
    # The operator names its columns lang_pred and score; own ones of that name are kept.
    own = {c: f"_own_{c}" for c in ("lang_pred", "score", "lang_known") if c in docs.columns}
    model.profiles = language.fit_profiles(docs)
    judged = language.identify(docs.withColumnsRenamed(own), model)
    kept = language.keep_known(judged).drop("lang_pred", "score")
    return kept.withColumnsRenamed({there: c for c, there in own.items()})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Near copies are what op3 links: fingerprints of three-word shingles that differ in at
    most two bits, and chains of these. Rows of one doc_id and group are one document; a
    group without any id keeps one row.
    """
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its place in the mixture in one more column, mix_order."""
    mixed = mixing.mix_sources(docs)
    return mixed.select([F.col(f"`{c}`") for c in docs.columns if c != "mix_order"] + ["mix_order"])


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture; what is returned is read back from them."""
    files = new_scratch_path(spark, "tokens")
    order = "mix_order" if "mix_order" in docs.columns else "doc_id"
    tokens.write_tokens(docs, files, tokenizer_path(), order_by=order, piece_bytes=PIECE_BYTES)
    return tokens.read_documents(spark, files)


STAGES = [
    ("language identification", identify_language),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix),
    ("token-ID output", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    # Only the token files are needed once they are written.
    with scratch_scope(spark, keep="tokens"):
        for name, stage in STAGES[:-1]:
            docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)
