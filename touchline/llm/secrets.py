"""Secret scans: candidate strings judged by a random forest, all in DataFrame expressions.

A candidate is a run of 16 or more letters, digits, ``+ / _ -``; the registered query also takes shorter values and
those with other signs where the text says what they are (``WIDE``): after a secret's name and ``=`` or ``:``, in URL
parameters and user information, after ``Bearer``, and signed tokens with dots. The forest sees its length, the kinds of
its characters, how surprising its character transitions are (against transitions inside the corpus's common
short words), how much of it those words cover, the path of its document, and the words next to it.
It is trained from labelled findings and removes false positives.

Defined cases: a null or empty text has no candidate; repeated rows and null ids are documents of their
own; findings without a label are not learned from; if all labelled findings agree, that label is every
candidate's chance, and without any it is 0. Extra columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import kept, table

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}"
_NAME = r"(?i:secret|token|passw(?:or)?d|passphrase|passwd|pwd|api.?key|access.?key|private.?key|account.?key|credential|auth)"
#: Look-behinds need a longest match: 128 signs before and behind the word in a name that tells a secret.
#: Runs as above, and before them the forms that tell a value of any signs.
WIDE = "|".join((
    r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    r"(?<==)(?<=[?&][A-Za-z0-9_.\-]{0,128}" + _NAME + r"[A-Za-z0-9_\-]{0,128}=)[^\s\"'`&#<>]{5,}[^\s\"'`&#<>.,;:)]",
    r"(?<=:)(?<=://[A-Za-z0-9_.%\-]{0,128}:)[^\s\"'`@/<>]{4,}(?=@)",
    r"(?<=[=:][>\s\"'`]{0,4})(?<=" + _NAME + r"[A-Za-z0-9_.\-]{0,128}[\"'`\]]{0,2}\s{0,2}(?:=>|:=|=|:)\s{0,2}[\"'`]?)(?!(?i:bearer|basic)\s)(?![A-Za-z][a-z+]{0,9}://)[^\s\"'`,;<>]{5,}[^\s\"'`,;<>.:)]",
    r"(?<= )(?<=(?i:bearer|basic) {1,2})(?=[^\s]*[0-9])[A-Za-z0-9._~+/=\-]{7,}[A-Za-z0-9_~+/=\-]",
    CANDIDATE,
))
#: Beginnings that issuers give their keys.
KNOWN = r"^((AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_\-]{16,}|sk[-_](live_|test_|ant-|proj-)?[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.)"
#: Values that stand for a secret without being one.
PLACEHOLDER = r"(?i)(your|example|changeme|change_me|placeholder|dummy)|^(x+|\*+|\.+|(.)\3{5,})$|^\$[({]|^\$[A-Z_]+$"
#: Letters before and after a candidate that count as its neighbourhood.
AROUND = 48
#: Common short words that make up the dictionary.
DICTIONARY = 200
#: Labelled findings of each kind to learn from, about.
PER_CLASS = 5000
TREES, DEPTH = 20, 6
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
FEATURES = ("length", "digits", "uppers", "changes", "surprise", "in_words", "in_path", "test_path", "assigned", "named", "quoted", "signs", "known", "header", "told", "placeholder")


def candidates(docs: DataFrame, path: str | None = "source", pattern: str = CANDIDATE) -> DataFrame:
    """(doc_id, nth, value, before, after, path): every candidate of every whole text with what is around it."""
    pieces = F.split("text", pattern, -1)
    other = lambda i: F.coalesce(F.get("found", i), F.lit(""))
    near = F.transform(
        F.col("found"),
        lambda c, i: F.struct(
            i.alias("nth"), c.alias("value"),
            F.right(F.concat(F.right(other(i - 1), F.lit(AROUND)), F.get("pieces", i)), F.lit(AROUND)).alias("before"),
            F.left(F.concat(F.get("pieces", i + 1), F.left(other(i + 1), F.lit(AROUND))), F.lit(AROUND)).alias("after"),
        ),
    )
    own = F.col(path).cast("string") if path else F.lit(None).cast("string")
    rows = docs.select("doc_id", own.alias("path"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), pieces.alias("pieces"))
    return rows.filter(F.size("found") > 0).select("doc_id", "path", F.inline(near)).select("doc_id", "nth", "value", "before", "after", "path")


def common_words(docs: DataFrame, n: int = DICTIONARY) -> list[tuple[str, int]]:
    """The most frequent words of three to six ASCII letters over all texts, with their counts."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{3,6}\b"), F.lit(0))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").count()
    return [(r["w"], r["count"]) for r in counts.orderBy(F.desc("count"), "w").limit(n).collect()]


def transition_table(words: list[tuple[str, int]]) -> str:
    """A letter for each pair of characters: how rare the second is after the first in the words, in
    half units of information, from ``A`` on."""
    side = len(ALPHABET)
    seen = [[0.5] * side for _ in range(side)]
    for w, n in words:
        for a, b in zip(w, w[1:]):
            seen[ALPHABET.index(a)][ALPHABET.index(b)] += n
    return "".join(chr(65 + min(40, round(-2 * math.log2(x / sum(row))))) for row in seen for x in row)


def with_features(found: DataFrame, words: list[tuple[str, int]]) -> DataFrame:
    """Add the forest's features."""
    value, low = F.col("value"), F.lower("value")
    length = F.length(value).cast("double")

    def without(pattern: str, of: Column = value) -> Column:
        return F.length(of) - F.length(F.regexp_replace(of, pattern, ""))

    known = F.regexp_replace(low, "[^a-z0-9]", "")
    lookup = F.lit(transition_table(words))
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(known, i, F.lit(1)))
    step = lambda i: F.ascii(F.substring(lookup, (place(i) - 1) * len(ALPHABET) + place(i + 1), F.lit(1))) - 65
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(known) - 1, F.lit(1))), step)
    surprise = F.aggregate(steps, F.lit(0), lambda a, x: a + x) / F.greatest(F.length(known) - 1, F.lit(1))
    covered = without("|".join(sorted((w for w, _ in words), key=lambda w: (-len(w), w))), low) / length if words else F.lit(0.0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return (
        found.withColumn("length", length)
        .withColumn("digits", without("[0-9]") / length)
        .withColumn("uppers", without("[A-Z]") / length)
        .withColumn("changes", F.regexp_count(value, F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])")) / length)
        .withColumn("surprise", surprise.cast("double"))
        .withColumn("in_words", covered)
        .withColumn("in_path", flag(value.contains("/") | F.col("before").rlike(r"(://|www\.)[^\s]*$")))
        .withColumn("test_path", flag(F.lower("path").rlike("test|example|sample|mock|fixture")))
        .withColumn("assigned", flag(F.col("before").rlike(r"[=:]\s*[\"']?$")))
        .withColumn("named", flag(F.lower("before").rlike(r"(secret|token|passw|pwd|api.?key|access.?key|private|credential|auth)[\w\s\"'=:.>\-]{0,12}$")))
        .withColumn("quoted", flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")))
        .withColumn("signs", without(r"[^A-Za-z0-9]") / length)
        .withColumn("known", flag(value.rlike(KNOWN)))
        .withColumn("header", flag(F.lower("before").rlike(r"(bearer|basic)\s+$|(authorization|x-[a-z\-]*(key|token))[\"']?\s*:\s*[\"']?(\w+\s+)?$") | (F.col("before").rlike(r"://[^\s/@:]*:$") & F.col("after").startswith("@"))))
        .withColumn("told", flag(F.lower("before").rlike(r"(secret|token|passw(or)?d|pwd|api.?key|access.?key|private.?key|credential)\s+(is|was|are)?:?\s*[\"'`]?$")))
        .withColumn("placeholder", flag(value.rlike(PLACEHOLDER)))
    )


def fit_forest(labelled: DataFrame, per_class: int = PER_CLASS, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
    """The forest, or the one label's value. ``labelled`` has the features, ``label`` (0 or 1) and ``pick``, a
    hash that chooses about ``per_class`` findings of each kind."""
    usable = labelled.filter("label is not null").withColumn("label", F.col("label").cast("double"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}  # a row per label
    if len(counts) < 2:
        return next(iter(counts), 0.0)
    rate = {k: min(1.0, per_class / n) for k, n in counts.items()}
    chance = F.pmod("pick", F.lit(1 << 20)) / float(1 << 20)
    sample = kept(usable.filter(chance < F.when(F.col("label") == 1, rate[1.0]).otherwise(rate[0.0])).select("label", *FEATURES), "findings")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(vectors)


def judge(found: DataFrame, forest) -> DataFrame:
    """Add ``p_secret``, the share of the trees' votes for a secret."""
    if isinstance(forest, float):
        return found.withColumn("p_secret", F.lit(forest))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(found)
    out = forest.setFeaturesCol("__features").setProbabilityCol("__chance").setRawPredictionCol("__raw").setPredictionCol("__guess").transform(vectors)
    return out.withColumn("p_secret", vector_to_array("__chance")[1]).drop("__features", "__chance", "__raw", "__guess")


def findings_by_rule(found: DataFrame) -> DataFrame:
    """Labels where no one has labelled findings, for two thirds of the documents; null where the rule does not know.

    Secrets are values with an issuer's beginning, and mixed values after a secret's name and ``=`` or ``:``, quoted or
    not, in headers, URLs, or told in prose. Not secrets are placeholders and, where nothing says secret, words,
    identifiers, paths and numbers. Other mixed values, such as a bare hash, and plain words after a name have no label.
    """
    yes = lambda c: F.col(c) == 1
    mixed = F.col("value").rlike("[A-Za-z]") & ((F.col("value").rlike("[0-9]") & F.col("digits").between(0.02, 0.95)) | F.col("value").rlike(r"[^A-Za-z0-9+/_.\-]"))
    stated = (yes("assigned") & yes("named")) | yes("header") | yes("told")
    plain = F.col("value").rlike(r"^[A-Za-z+/_\-]+$") | ~F.col("value").rlike("[A-Za-z]") | (yes("in_path") & (F.col("in_words") >= 0.3) & (F.col("digits") < 0.2))
    rule = F.when(yes("placeholder"), 0).when(yes("known") | (stated & mixed), 1).when(~stated & ~yes("named") & plain, 0)
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1
    return found.withColumn("label", F.when(learn, rule)).withColumn("pick", F.xxhash64("doc_id", "nth"))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    found = kept(with_features(candidates(docs, pattern=WIDE), common_words(docs)), "candidates")
    out = judge(found, fit_forest(findings_by_rule(found)))
    return out.select("doc_id", "nth", F.col("length").cast("int").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("p_secret", 6).alias("p_secret"), (F.col("p_secret") >= 0.5).alias("is_secret"))
