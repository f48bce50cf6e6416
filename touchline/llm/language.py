"""Language identification by hierarchical discrimination.

A first layer of linear support vector machines, one per family against the rest, predicts the language
family; inside it, one-versus-one machines separate the languages, and most votes win. Features are
hashed counts of letter pairs and triples (bytes of the lower-cased UTF-8 text) over the whole text.

The machines are fitted on a bounded sample of the labelled rows: about ``per_language`` of each language, and
about ``family_rows`` in all for a family machine, chosen by a hash. Each machine is fitted in its own task.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if there is no
labelled row. Rows with null lang are predicted and not learned from. A null doc_id counts as an empty
string for the split. Equal texts get equal predictions. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import kept, table

#: Languages by family; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "mk"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "uralic": ("fi", "et", "hu"),
}
DIMS = 2048
PER_LANGUAGE = 1000
FAMILY_ROWS = 8000
#: Below this score the pipeline lets a document go.
MIN_SCORE = 0.2
_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0] in langs), lang)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of the root counts of hashed byte pairs and triples; runs of other characters are a space."""
    words = b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())
    b = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    pairs = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(2246822519)
    triples = pairs[:-1] * np.uint32(3266489917) + b[2:] * np.uint32(668265263)
    shift = np.uint32(32 - (DIMS.bit_length() - 1))
    x = np.sqrt(np.bincount(pairs >> shift, minlength=DIMS) + np.bincount(triples >> shift, minlength=DIMS))
    return (x / max(float(np.linalg.norm(x)), 1e-9)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss, by dual coordinate steps.

    ``y`` is 1 or -1; the rarer class counts as much as the other.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    share = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    soft = np.array([share[int(s)] / (len(y) / 2 * cost) / 2 for s in y])
    norms = (x * x).sum(axis=1) + soft
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            slope = y[i] * (w @ x[i]) - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norms[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, family_rows: int = FAMILY_ROWS) -> dict:
    """Learn from (text, lang, pick), ``pick`` being a hash that chooses the sample. The result holds the
    languages by family and a weight vector for each machine."""
    usable = labelled.filter("lang is not null and text is not null")
    counts = usable.groupBy("lang").count().orderBy("lang").collect()  # a row per language
    langs = [r["lang"] for r in counts]
    rate = {r["lang"]: min(1.0, per_language / r["count"]) for r in counts}
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    machines = [("family", f, "") for f in families] if len(families) > 1 else []
    machines += [("pair", a, b) for own in families.values() for i, a in enumerate(own) for b in own[i + 1 :]]
    out: dict = {"families": families, "weights": {}}
    if not machines:
        return out
    size = sum(min(per_language, r["count"]) for r in counts)
    in_family = min(1.0, family_rows / size)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lang, text, u in zip(pdf["lang"], pdf["text"], pdf["u"]):
                own = family_of(lang)
                if u >= rate[lang] or not has_letter(text):
                    continue
                v = features(text).tobytes()
                for k, (kind, a, b) in enumerate(machines):
                    if kind == "pair" and lang in (a, b):
                        rows.append((k, 1 if lang == a else -1, v))
                    elif kind == "family" and u < rate[lang] * in_family:
                        rows.append((k, 1 if own == a else -1, v))
            if rows:
                yield pd.DataFrame(rows, columns=["machine", "y", "v"])

    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["v", "y"])
        x = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(pdf), DIMS)
        w = fit_svm(x, pdf["y"].to_numpy(np.float64))
        return pd.DataFrame({"machine": [key[0]], "w": [w.tolist()]})

    u = (F.pmod("pick", F.lit(1 << 20)) / float(1 << 20)).alias("u")
    sample = usable.select("lang", "text", u).filter(F.col("u") < F.lit(max(rate.values())))
    fitted = sample.mapInPandas(vectors, "machine int, y int, v binary").groupBy("machine").applyInPandas(train, "machine int, w array<double>")
    for r in fitted.collect():  # a row per machine
        out["weights"][machines[r["machine"]]] = np.array(r["w"])
    return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """The rows with lang_pred and score. The score is the share of the family layer's and the winning
    machines' confidence, both logistic in the margin."""
    families, weights = model["families"], model["weights"]
    names = list(families)
    zero = np.zeros(DIMS + 1)
    top = np.array([weights.get(("family", f, ""), zero) for f in names]).T if names else None
    sent = docs.sparkSession.sparkContext.broadcast((families, weights, top))
    text = next(c for c in docs.columns if c.lower() == "text")

    def sure(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-3 * np.clip(z, -20, 20)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        families, weights, top = sent.value
        for texts in batches:
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t is not None and families and has_letter(t)]
            for k in range(0, len(at), 256):
                part = at[k : k + 256]
                x = np.array([features(texts.iloc[i]) for i in part])
                x = np.hstack([x, np.ones((len(part), 1), np.float32)])
                margins = x @ top
                best = margins.argmax(axis=1)
                chance = sure(margins[np.arange(len(part)), best]) if len(families) > 1 else np.ones(len(part))
                for f in np.unique(best):
                    own, rows = families[list(families)[f]], np.flatnonzero(best == f)
                    votes = np.zeros((len(rows), len(own)))
                    for a in range(len(own)):
                        for b in range(a + 1, len(own)):
                            p = sure(x[rows] @ weights.get(("pair", own[a], own[b]), zero))
                            votes[:, a] += (p >= 0.5) + p / len(own) ** 2
                            votes[:, b] += (p < 0.5) + (1 - p) / len(own) ** 2
                    win = votes.argmax(axis=1)
                    for j, r in enumerate(rows):
                        w = own[win[j]]
                        duels = [(1 if (w, o) in pairs else -1, (w, o) if (w, o) in pairs else (o, w)) for o in own if o != w for pairs in [{(c, d) for _, c, d in weights}]]
                        p = [float(sure(s * (x[r] @ weights[("pair", *d)]))) for s, d in duels]
                        lang[part[r]], score[part[r]] = w, chance[r] * (sum(p) / len(p) if p else 1.0)
            yield pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1)})

    guess = F.pandas_udf(run, "lang_pred string, score double")
    return docs.withColumn("__guess", guess(F.col(text))).select(*docs.columns, "__guess.lang_pred", "__guess.score")


def held_out() -> F.Column:
    """Documents that are kept from learning: the checksum of the id as text leaves 1 by 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_on_documents(docs: DataFrame) -> dict:
    own = docs.select("doc_id", "text", "lang").filter(~held_out())
    return fit(own.select("text", "lang", F.xxhash64("text", F.col("doc_id").cast("string")).alias("pick")))


def known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is told with at least ``min_score``; the rest, those without letters
    among them, go. Without a labelled row nothing can be told apart and only texts without letters go."""
    model = fit_on_documents(docs)
    if not model["families"]:
        letters = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
        return docs.filter(letters)
    slim = predict(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")), model)
    return slim.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("row.*")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    guessed = predict(docs.select("doc_id", "text"), fit_on_documents(docs))
    return guessed.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
