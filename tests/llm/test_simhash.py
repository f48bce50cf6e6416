"""SimHash against a plain computation on every pair."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from touchline.llm import simhash
from touchline.llm.common import components


def brute_fp(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", "  \n", "One", "a b c", "a b c d", "É é É x\x0by", "a b c d " * 40]
    texts += [" ".join(rng.choice(["Ab", "c", "D", "eé"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]


@pytest.mark.parametrize("dense", [1, 3, 4096])
def test_links(spark, dense):
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.close_edges(df, dense=dense)).collect()}
    groups = {}
    for x in fps:
        s = x - (1 << 64) if x >> 63 else x
        groups.setdefault(got.get(s, s), set()).add(x)
    expect = {}
    for x, r in want.items():
        expect.setdefault(r, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_components_of_a_path(spark):
    n = 200
    got = {r.node: r.root for r in components(spark.range(n - 1).selectExpr("id as a", "id + 1 as b")).collect()}
    assert len(got) == n and len(set(got.values())) == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base.upper(), "x"), (9, base + " tail", None), (None, base, "x"), (7, None, "x"), (8, "", "x"), (7, None, "x"), (1, "alone here now", "x"), (None, "nobody knows this one", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_no string")
    numbered = df.selectExpr("*", "monotonically_increasing_id() as k")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(numbered, "k").collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (None, 3), (7, 7), (8, 7), (7, 7), (1, 1), (None, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(3, base.upper()), (7, None), (1, "alone here now"), (None, "nobody knows this one")], key=str)
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_query_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in simhash.op9_simhash(spark, folder).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    fps = {i: brute_fp(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == fps
    assert {i: r.component_id for i, r in rows.items()} == brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)


@pytest.mark.parametrize("dense", [4096, 16])
def test_rows_of_many_blocks_are_not_sent_to_every_task(spark, dense):
    rng = random.Random(3)
    # one block in common and the rest at random, or nothing in common
    fps = {rng.getrandbits(63) & ~0x3FFFFFFF for _ in range(300)} if dense == 16 else {rng.getrandbits(63) for _ in range(20000)}
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "12m")
    try:
        got = simhash.close_edges(frame, dense=dense).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert all((r.a ^ r.b).bit_count() <= 4 for r in got)
