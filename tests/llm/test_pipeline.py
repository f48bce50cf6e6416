"""The pipeline's stages on odd rows and one after the other."""

from __future__ import annotations

import pytest

import corpus_pipeline
from touchline.llm.common import kept, numbered

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, shard int, word string, score double, size long"
    texts = {"en": "the cat and the dog went over there with that thing", "fr": "le chat est dans la maison avec les autres chiens", "de": "der hund und die katze sind nicht auf dem haus"}
    rows = [(i, f"{t} {i}x{i * 7} {' '.join(f'{lang}{i}{k}' for k in range(20))}", lang, f"s{i % 3}", 5, "k", 1, "w", 0.1, 2) for i, (lang, t) in enumerate(list(texts.items()) * 12)]
    rows += [(None, "no id at all here", None, None, None, None, None, None, None, None), (1, None, "en", "s1", None, None, None, None, None, None), (2, "", "en", "s2", 0, None, None, None, None, None)]
    rows += [(3, "123 456 !!!", "en", "s0", 11, None, None, None, None, None), (40, "same words in both rows here", "en", "s0", 1, None, None, None, None, None)] + [(41, "same words in both rows here", "en", "s0", 1, None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("written", [False, True])
def test_stages_on_odd_rows(spark, odd, written):
    docs = kept(odd, "odd") if written else odd
    for name, stage in corpus_pipeline.STAGES:
        out = kept(stage(spark, docs, FOLDER), name)
        if name != "sharding":
            assert out.columns == odd.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        assert out.columns[: len(odd.columns)] == odd.columns
        if name == "language_id":
            assert sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").exceptAll(out.select("doc_id", "text")).collect()) == [(1, None), (2, ""), (3, "123 456 !!!")]
        if name == "near_duplicates":
            assert out.filter("doc_id >= 40").count() == 1
        docs = out
    assert docs.count() > 20
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0, name


def test_row_keys(spark, odd):
    for docs in (odd, kept(odd.repartition(3), "odd"), kept(odd, "odd").filter("doc_id > 3"), odd.union(odd)):
        rows, key = numbered(docs)
        assert rows.select(key).distinct().count() == docs.count() and key == "row_key_"


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "shard_bytes"]
    rows = out.collect()
    assert rows and all(r.text for r in rows)
