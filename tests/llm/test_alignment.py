"""Tokenizer alignment against plain loops over tokens, documents and pairs."""

from __future__ import annotations

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from touchline.llm import alignment as A
from touchline.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(A.PIECES), reason="no tokenizer files")


def spelled(ids, codec):
    return [codec.bytes[i] for i in ids]


def plain(docs):
    """Every document's numbers by walking its bytes; both tokenizers by the libraries they were made for."""
    a_codec, b_codec = A._codecs(A.BYTE_LEVEL, A.PIECES)
    holders, done = defaultdict(set), []
    for k, (doc_id, text) in enumerate(docs):
        a = a_codec.tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_codec.model.encode(text) if text else []
        whole = b" " + (text or "").encode()
        if not text or b"".join(spelled(a, a_codec)) != whole or b"".join(spelled(b, b_codec)) != whole:
            a, b = [], []
        at, spans = 0, ([], [])
        for side, ids, codec in ((0, a, a_codec), (1, b, b_codec)):
            at = 0
            for i in ids:
                spans[side].append((at, at + len(codec.bytes[i]), i))
                at += len(codec.bytes[i])
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in spans))
            lo = hi
        owner = np.repeat(np.arange(len(b)), [e - s for s, e, _ in spans[1]])
        links = Counter()
        for s, e, i in spans[0]:
            for j in np.unique(owner[s:e]).tolist():
                links[i, b[j]] += 1
        for p in links:
            holders[p].add(k)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        done.append((doc_id, len(a), len(b), len(groups), links, digest))
    most = Counter()
    for (i, _), who in holders.items():
        most[i] = max(most[i], len(who))
    return sorted((
        (d, n, m, g, sum(l.values()), sum(c for p, c in l.items() if len(holders[p]) == most[p[0]]), sum(c * len(holders[p]) for p, c in l.items()), h)
        for d, n, m, g, l, h in done
    ), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
DOCS = [
    (1, "Hello world, this is a test."), (2, "Hello world, this is a test."), (3, None), (4, ""), (5, "Grüße aus Köln – naïve façade"), (6, " two  spaces "),
    (7, "a<|endoftext|>b </s> <unk>"), (8, "日本語のテキスト と emoji 🙂🙃"), (9, "x" * 3000), (10, "line\nbreaks\tand\r\ntabs"), (11, "▁piece mark"), (12, "nul \x00 byte"),
    (None, "Hello world"), (13, " "), (14, "words and numbers 12345 6,789.00 " * 300), (15, " no-break spaces"), (16, "ǅ Ω Ж ԱԲ א ع"),
]


def test_gallop_counts_what_lies_below():
    rng = np.random.default_rng(3)
    for _ in range(300):
        top = int(rng.integers(2, 200))
        x, y = (np.unique(np.append(rng.integers(1, top + 1, int(rng.integers(1, top))), top)) for _ in range(2))
        want = np.searchsorted(y, x)
        assert A.gallop(x, y, rng.integers(-5, len(y) + 5, len(x))).tolist() == want.tolist()
        assert A.ranks(x, y, 4).tolist() == want.tolist()


def test_faster_encoder_gives_the_same_ids():
    codec = A._codecs(A.BYTE_LEVEL, A.PIECES)[0]
    texts = [t for _, t in DOCS if t]
    assert codec.ranks is not None
    assert codec.encode(texts) == [codec.tokenizer.encode(" " + t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("block", [1, 500, A.BLOCK])
def test_against_plain_loops(spark, block):
    df = spark.createDataFrame([(*d, "c", 1) for d in DOCS], "doc_id long, text string, links string, block int").repartition(2)
    rows, counts = A.token_alignment(df, block=block)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows.collect()), key=str) == plain(DOCS)
    assert counts.filter("best").select("a").distinct().count() == counts.select("a").distinct().count()


def test_empty_table_and_no_tokens(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.token_alignment(df)[0].count() == 0
    none = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert [tuple(r[c] for c in COLUMNS) for r in A.token_alignment(none)[0].collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_whole_table_against_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op12_alignment"](spark, folder).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str) == plain(docs)
