from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F
from tallymart.llm import language

WORDS = {"en": "the cat and dog sat there while they looked out over this house with some other people",
         "fr": "le chat et le chien sont dans une maison avec des autres hommes qui regardent vers la rue"}
FOREIGN = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."


def test_unlearned_languages_and_gibberish_go_and_clean_texts_stay(spark):
    rng = random.Random(3)
    rows = []
    for lang, text in WORDS.items():
        words = text.split()
        rows += [(len(rows) + k, " ".join(rng.choices(words, k=rng.choice([1, 5, 40]))), lang)
                 for k in range(60)]
    clean = len(rows)
    rows += [(clean, FOREIGN, None), (clean + 1, "人人生而自由,在尊严和权利上一律平等。", None),
             (clean + 2, "xqzjv kqwxz pvvk zzqjx wkkvq hhgzx qqpzx jjkxv", None),
             (clean + 3, "12 34", None), (clean + 4, None, None),
             (clean + 5, "the dog and the cat looked over there", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == [*range(clean), clean + 5]
    unlabelled = docs.where("lang IS NULL")
    assert corpus_pipeline.identify_language(spark, unlabelled, "").count() == 6


def test_the_stage_goes_by_the_language_that_the_operator_names(spark, monkeypatch):
    rows = [(2 * n + k, text, lang, "own") for n in range(30)
            for k, (lang, text) in enumerate(WORDS.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == rows
    identify = language.identify

    def misled(docs, model):
        named = F.when(F.col("doc_id") == 4, "fr").when(F.col("doc_id") == 7, "und")
        return identify(docs, model).withColumn("lang_pred", F.coalesce(named, "lang_pred"))

    monkeypatch.setattr(language, "identify", misled)
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert sorted(r[0] for r in kept.collect()) == [n for n in range(60) if n not in (4, 7)]


def test_the_stage_reads_its_texts_in_one_python_step(spark):
    # Two of them in one stage would be two workers for every task, all of which stay in memory.
    rows = [(2 * n + k, text, lang, ["own"]) for n in range(30)
            for k, (lang, text) in enumerate(WORDS.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_known array<string>")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, kept.collect())) == rows
