"""Language identification: held-out accuracy, the split, odd rows."""

from __future__ import annotations

import zlib

import numpy as np

from touchline.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = language.op4_language(spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_machine():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x @ [2, -1, 0.5, 0, 0] + 0.3 > 0, 1.0, -1.0)
    w = language.fit_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_odd_rows(spark):
    rows = [(i, f"the cat and the dog {i}", "en", "en") for i in range(20)] + [(i, f"le chat et les chiens {i}", "fr", "x") for i in range(20, 40)]
    rows += [(i, f"el gato y los perros {i}", "es", None) for i in range(40, 60)] + [(60, None, "en", None), (61, "", "fr", None), (62, "12 !", "en", None), (63, "the dog", None, None), (None, "les chats", "fr", None), (5, "the cat and the dog 5", "en", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language.fit_on_documents(df)
    assert set(model["families"]) == {"germanic", "romance"} and ("pair", "es", "fr") in model["weights"]
    got = {r.doc_id: r for r in language.predict(df.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (60, 61, 62))
    assert got[63].lang_pred == "en" and got[None].lang_pred == "fr"
    kept = language.known_language(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in df.exceptAll(kept).collect()) == ["60", "61", "62"]
    one = language.fit_on_documents(df.filter("lang = 'en'"))
    assert {r.lang_pred for r in language.predict(df.select("text"), one).collect()} == {"en", "und"}
    none = language.fit_on_documents(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(df.select("text"), none).collect()} == {("und", 0.0)}
    assert language.known_language(df.limit(0)).count() == 0
