"""Ranked search: against plain scoring of every document and item, and against SQL on a whole table."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from oracle import compare, connect

from touchline.llm import bag_ranking as B
from touchline.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, depth=10):
    words = [Counter(terms(t)) for _, t in docs]
    n = [sum(w.values()) for w in words]
    big_n, total = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in words for w in c)
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, _), c, size in zip(docs, words, n):
            score = 0
            for w in terms(text):
                if c[w]:
                    m = 100 - 75 + (75 * size * big_n) // total
                    score += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k, x[3], -x[0]) for k, x in enumerate(sorted(found)[:depth], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, "c", 7) for x in docs], "doc_id long, text string, bag string, place int").repartition(3)
    i = spark.createDataFrame([(*x, "c", 7) for x in items], "item_id string, text string, term string, item int").repartition(2)
    rows = B.ranked(d, i, **how).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in rows), key=str)


def made_up(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "ÀB", "x1", " "]
    text = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choice(words) for _ in range(n))
    docs = [(k, text(rnd.randint(0, 40))) for k in range(60)]
    docs += [(100 + k, docs[5][1]) for k in range(25)] + [(200 + k, docs[k][1].upper() + " other words") for k in range(10)]
    docs += [(None, docs[5][1]), (7, docs[7][1]), (300, None), (301, ""), (302, "!!"), (303, "w1 " * 4000), (304, None)]
    items = [(f"i{k}", text(rnd.randint(0, 8))) for k in range(12)] + [("i0", "w1 W1 w2"), (None, "w3"), ("none", None), ("blank", " "), ("far", "unseen")]
    return docs, items


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_scoring(spark, seed):
    docs, items = made_up(seed)
    assert got(spark, docs, items) == plain(docs, items)


def test_many_blocks_give_the_same(spark):
    docs, items = made_up(5)
    assert got(spark, docs, items, block_words=12) == plain(docs, items)


def test_a_large_class_and_ties(spark):
    docs = [(k, "same words") for k in range(300, 0, -1)] + [(1000, "same words and more")]
    assert got(spark, docs, [("a", "same"), ("b", "more same")]) == plain(docs, [("a", "same"), ("b", "more same")])


def test_empty_tables(spark):
    docs, items = made_up(1)
    assert got(spark, [], items) == got(spark, docs, []) == got(spark, [(1, None)], items) == []


def test_whole_table_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    compare(QUERIES["op11_bag_ranking"](spark, folder), connect(folder), ORACLES["op11_bag_ranking"])
