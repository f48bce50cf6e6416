"""The classifier chain: planted words, out-of-fold chain, odd rows."""

from __future__ import annotations

import random

from touchline.llm import toxicity


def frames(spark):
    rng = random.Random(0)
    clean = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    bad = ["snargle", "blorfing", "grumbuck"]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [rng.choice(clean) for _ in range(30)] + (rng.sample(bad, 2) if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words), "p", 0.5))
        if i < 300:
            labels.append((i, int(not toxic or i % 2), int(toxic), "text"))
    docs += [(900, None, "p", 0.5), (901, "", "p", 0.5), (None, "a blorfing snargle of grumbuck", "p", 0.5), (0, docs[0][1], "p", 0.5)]
    labels += [(1, None, 0, None), (2, 1, None, None), (0, 0, 1, None), (None, 1, 1, None), (5000, 1, 1, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, p_toxic string, x double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_chain(spark):
    docs, labels = frames(spark)
    categories = ["toxic", "toxic_low_quality"]
    model = toxicity.fit_chain(docs, toxicity.label_categories(labels), categories)
    assert {"snargle", "blorfing", "grumbuck"} <= set(model["features"])
    assert [len(w) for w in model["weights"]] == [len(model["features"]) + 1, len(model["features"]) + 2]
    got = toxicity.predict_chain(docs.select("doc_id", "text"), model)
    assert got.columns == ["doc_id", "text", "p_toxic", "p_toxic_low_quality"]
    rows = {r.doc_id: r for r in got.collect()}
    assert all((rows[i].p_toxic > 0.7) == (i % 5 == 0) for i in range(400))
    assert rows[None].p_toxic > 0.7 and rows[900].p_toxic < 0.5 and rows[901].p_toxic == rows[900].p_toxic
    assert rows[10].p_toxic_low_quality > rows[11].p_toxic_low_quality
    again = toxicity.fit_chain(docs.repartition(5), toxicity.label_categories(labels), categories)
    assert again["features"] == model["features"]


def test_without_labels(spark):
    docs, labels = frames(spark)
    for own in (labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.fit_chain(docs, toxicity.label_categories(own), ["toxic", "toxic_low_quality"])
        assert toxicity.predict_chain(docs.select("text"), model).filter("p_toxic <> 0 or p_toxic_low_quality <> 0").count() == 0
    model = toxicity.fit_chain(docs, toxicity.label_categories(labels), ["toxic"])
    assert toxicity.predict_chain(docs.select("text").limit(0), model).count() == 0


def test_sample_is_bounded_by_rows(spark):
    """One doc_id on most rows, with equal and with different texts."""
    docs, labels = frames(spark)
    more = spark.range(20000).selectExpr("5L AS doc_id", "concat('many ', id) AS text").unionByName(spark.range(20000).selectExpr("10L AS doc_id", "'same' AS text"))
    sample = toxicity.labelled_sample(docs.select("doc_id", "text").unionByName(more), toxicity.label_categories(labels), ["toxic", "toxic_low_quality"], 500)
    assert 300 < sample.count() < 3 * 2 * 500


def test_a_later_category_has_words_of_its_own(spark):
    rng = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    docs, labels = [], []
    for i in range(600):
        a, b = i % 3 == 0, i % 20 == 0
        docs.append((i, " ".join(rng.choice(words) for _ in range(20)) + (" snargle" if a else "") + (" blorfing" if b else "")))
        labels.append((i, int(a), int(b), 0))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, a int, b int, never int")
    model = toxicity.fit_chain(d, l, ["never", "a", "b"])
    assert {"snargle", "blorfing"} <= set(model["features"])
    rows = toxicity.predict_chain(d, model).collect()
    assert all((r.p_a > 0.5) == (r.doc_id % 3 == 0) and (r.p_b > 0.5) == (r.doc_id % 20 == 0) and r.p_never < 0.01 for r in rows)
