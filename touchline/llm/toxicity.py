"""Toxicity with a chain of linear classifiers.

Categories are predicted one after the other; each model sees the words of the text and the probabilities
of the categories before it. While learning, those probabilities come from models that did not see the
row (out-of-fold), so later models learn how far the earlier ones can be trusted.

Features are whole lower-cased words and word beginnings of five letters that tell a category apart, chosen
for each by the significance of their log-odds. Everything is fitted on a bounded sample of labelled rows:
about ``per_class`` of every combination of categories, and twice as many without any. Prediction reads every
whole text.

Defined cases: a null or empty text has no features and gets the models' base probability; without labelled
rows that differ in a category every probability is 0, and a category of one value has that probability. Labels with a null are not learned from; of repeated labels of
a doc_id the largest values count. Repeated documents and null ids are rows of their own. Extra columns are
not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import kept, table

PER_CLASS = 2500
FEATURES = 1024
#: Standard errors that a feature's log-odds must be away from 0.
LEAST_Z = 2.5
FOLDS = 5
#: Probability of the first category from which a text counts as toxic; clean texts stay below it.
DECISION = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def text_features(text: str | None) -> set[str]:
    """Words of a text, and the first five letters of longer ones with a mark."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:5] + "-" for w in words if len(w) > 5}


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], per_class: int = PER_CLASS) -> DataFrame:
    """(text, fold, *categories) of a bounded share of the labelled documents: of every combination of
    categories about ``per_class`` rows, of that without any twice as many. A hash of doc_id and text picks
    them, so rows that share a doc_id are counted one by one, and equal rows once."""
    known = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    counts = docs.select("doc_id").join(known, "doc_id").groupBy(*categories).count().collect()  # a row per combination
    rate = {tuple(r[c] for c in categories): min(1.0, per_class * (1 if any(r[c] for c in categories) else 2) / r["count"]) for r in counts}
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    own = F.lit(0.0)
    for kind, share in rate.items():
        own = F.when(reduce(and_, [F.col(c) == v for c, v in zip(categories, kind)]), F.lit(share)).otherwise(own)
    some = docs.select("doc_id", "text").withColumn("pick", pick).filter(F.col("pick") < max(rate.values(), default=0.0))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    return some.join(known, "doc_id").filter(F.col("pick") < own).drop("pick").distinct().select("text", fold.alias("fold"), *categories)


def telling_features(sample: DataFrame, first: str, n: int = FEATURES) -> list[str]:
    """For one category, the features whose log-odds between documents with and without the category are most significant."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = (Counter(), Counter())
            for text, y in zip(pdf["text"], pdf[first]):
                seen[int(y)].update(text_features(text))
            names = list(seen[0].keys() | seen[1].keys())
            if names:
                yield pd.DataFrame({"f": names, "a": [seen[1][f] for f in names], "b": [seen[0][f] for f in names]})

    sizes = {r[first]: r["count"] for r in sample.groupBy(first).count().collect()}
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (sizes.get(1, 0) + 1 - a)) - F.log(b / (sizes.get(0, 0) + 1 - b))
    counts = sample.select("text", first).mapInPandas(run, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    scored = counts.filter(F.col("a") + F.col("b") >= 2).select("f", F.abs(odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    return [r["f"] for r in scored.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(n).collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a balanced, ridge-penalised logistic regression, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    positive = float(y.sum())
    if positive in (0.0, float(len(y))):
        return np.append(np.zeros(x.shape[1] - 1), -30.0 if not positive else 30.0)
    weight = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * (len(y) - positive)))
    ridge = np.append(np.full(x.shape[1] - 1, penalty), 0.0)
    step = 1 / (0.25 * float((weight[:, None] * x * x).sum(axis=1).sum()) / 4 + penalty)
    w = z = np.zeros(x.shape[1])
    loss = np.inf
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * z
        new = z - step * g
        q = np.clip(x @ new, -30, 30)
        now = float((weight * (np.logaddexp(0, q) - y * q)).sum() + 0.5 * (ridge * new * new).sum())
        if now > loss + 1e-9:
            step, z = step / 2, w
            continue
        loss = now
        z, w = new + k / (k + 3) * (new - w), new
        step *= 1.1
    return w


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], per_class: int = PER_CLASS, features: int = FEATURES) -> dict:
    """The features and, per category, weights over them, the earlier categories' probabilities and a bias."""
    categories = list(categories)
    sample = kept(labelled_sample(docs, labels, categories, per_class), "labelled")
    seen = sample.agg(*[F.min(c).alias(f"a{k}") for k, c in enumerate(categories)], *[F.max(c).alias(f"b{k}") for k, c in enumerate(categories)]).first()
    model: dict = {"categories": categories, "features": [], "weights": []}
    told = [c for k, c in enumerate(categories) if seen[f"a{k}"] != seen[f"b{k}"]]  # the others have one value
    if not told:
        return model
    names = list(dict.fromkeys(f for c in told for f in telling_features(sample, c, features // len(told))))
    at = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns="text")
            out["has"] = [sorted(at[f] for f in text_features(t) & at.keys()) for t in pdf["text"]]
            yield out.assign(one=0)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[tuple(h) for h in pdf["has"]]).sort_values(["fold", "key", *categories])
        x = np.zeros((len(pdf), len(names)), np.float32)
        for i, has in enumerate(pdf["has"]):
            x[i, np.asarray(has, int)] = 1
        fold, found = pdf["fold"].to_numpy(), []
        for c in categories:
            y = pdf[c].to_numpy(np.float64)
            found.append(fit_logistic(x, y).tolist())
            out_of_fold = np.zeros(len(y))
            for k in np.unique(fold):
                own = fold == k
                out_of_fold[own] = _chance(x[own], fit_logistic(x[~own], y[~own])) if (~own).any() else y.mean()
            x = np.hstack([x, out_of_fold[:, None].astype(np.float32)])
        return pd.DataFrame({"c": range(len(categories)), "w": found})

    kinds = ", ".join(f"`{c}` int" for c in categories)
    vectors = sample.mapInPandas(rows, f"fold int, {kinds}, has array<int>, one int")
    fitted = {r["c"]: r["w"] for r in vectors.groupBy("one").applyInPandas(train, "c int, w array<double>").collect()}  # the bounded sample
    model["features"], model["weights"] = names, [np.array(fitted[i]) for i in range(len(categories))]
    return model


def predict_chain(docs: DataFrame, model: dict) -> DataFrame:
    """The rows with ``p_<category>`` for every category of the chain."""
    names = [f"p_{c}" for c in model["categories"]]
    sent = docs.sparkSession.sparkContext.broadcast(({f: i for i, f in enumerate(model["features"])}, model["weights"]))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        at, weights = sent.value
        for texts in batches:
            out = np.zeros((len(texts), len(names)))
            for i, text in enumerate(texts):
                has = [at[f] for f in text_features(text) & at.keys()] if weights else []
                for k, w in enumerate(weights):
                    z = w[has].sum() + w[len(at) : len(at) + k] @ out[i, :k] + w[-1]
                    out[i, k] = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))
            yield pd.DataFrame(out, columns=names)

    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    guess = F.pandas_udf(run, kind)
    return docs.withColumn("__p", guess(F.col("text"))).select(*docs.columns, "__p.*")


def label_categories(labels: DataFrame) -> DataFrame:
    """The two categories that the labels table tells: toxic, and toxic in a text of low quality."""
    toxic = F.col("toxic").cast("int")
    return labels.select("doc_id", toxic.alias("toxic"), (toxic * (1 - F.col("quality").cast("int"))).alias("toxic_low_quality"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = label_categories(table(spark, folder, "labels"))
    model = fit_chain(docs, labels, ["toxic", "toxic_low_quality"])
    return predict_chain(docs, model).select("doc_id", "p_toxic", "p_toxic_low_quality", (F.col("p_toxic") >= DECISION).alias("toxic"))
