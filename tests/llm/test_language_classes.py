from __future__ import annotations

from tallymart.llm import language, queries


def test_every_language_is_learned(spark):
    queries.small_batches(spark)
    names = [f"l{n}" for n in range(207)]
    docs = spark.createDataFrame(
        [(n, f"{name}word{name} and {name}", name) for n, name in enumerate(names)],
        "doc_id long, text string, lang string")
    drawn = language.training_sample(docs).collect()
    assert {r["lang"] for r in drawn} == set(names)
    model = language.fit(docs)
    assert sorted(x for members in model.members.values() for x in members) == sorted(names)
    assert set(model.families) == set(names)


def test_family_machines_take_fewer_rows_of_more_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MACHINE_ROWS", 4)
    texts = {"en": "the cat and the dog", "fr": "le chat et le chien"}
    docs = spark.createDataFrame(
        [(n, f"{texts[x]} {n}", x) for n in range(20) for x in texts],
        "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.predict("the dog")[0] == "en" and model.predict("le chien")[0] == "fr"
