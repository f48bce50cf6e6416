"""Names as people type them: similar words, search with typo correction, mentions in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.ordered import task_spread
from touchline.functions.words import normalize_name
from touchline.operators.text import resolve_names, tokens
from touchline.session import written

# Cut-offs of similarity, least lengths, and words that never mean a player on their own
SEARCH_CUTOFF, MENTION_CUTOFF, MIN_LETTERS, MIN_LETTERS_TYPO = 0.80, 0.88, 4, 5
STOP_WORDS = (
    "the and for with from this that than then have has been about into over under only also very just like "
    "what which when where does will would could should much many more most least best worst better next last total "
    "highest lowest average score scores scored scorer scorers point points goal goals assist assists clean sheet sheets "
    "player players team teams season seasons gameweek week game games match matches compare comparison versus between "
    "form value price cost predict prediction predicted captain pick tell show give list find minutes bonus fixture "
    "fixtures league premier fantasy stats statistics performance record records history yellow cards card saves save "
    "keeper goalkeeper goalkeepers defender defenders midfielder midfielders forward forwards striker strikers winger wingers "
    "home away against good great nice thanks hello please young city united town rovers wanderers athletic albion"
).split()

#: Letters that one number of the bit-parallel subsequence holds.
LIMB = 60


# ------------------------------------------------------------------ similarity of words

def letter_bits(word: Column) -> Column:
    """Per LIMB letters of a word, a map from letter to the places it stands at, as bits."""

    def limb(j: Column) -> Column:
        part = F.split(F.substring(word, j * LIMB + 1, F.lit(LIMB)), "")
        bits = lambda letter: F.aggregate(
            F.transform(part, lambda x, i: F.when(x == letter, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
        letters = F.array_distinct(part)
        return F.map_from_arrays(letters, F.transform(letters, bits))

    return F.transform(F.sequence(F.lit(0), F.floor((F.length(word) - 1) / LIMB).cast("int")), limb)


def common_letters(word: Column, length: Column, bits: Column) -> Column:
    """Length of the longest common subsequence of ``word`` and a word given by its length and ``letter_bits``.

    One bit per letter of the second word stays set until a letter of the first one uses it up; adding
    the places of a letter to the set bits moves all of them at once, with a carry between limbs.
    """
    zero = F.lit(0).cast("long")
    full = F.transform(bits, lambda _, j: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.lit(LIMB), length - j * LIMB)) - 1)

    def letter(state: Column, x: Column) -> Column:
        def limb(acc: Column, z: Column) -> Column:
            used = z["v"].bitwiseAND(F.coalesce(z["b"][x], zero))
            total = z["v"] + used + acc["carry"]
            left = total.bitwiseOR(z["v"] - used).bitwiseAND(z["f"])
            return F.struct((total > z["f"]).cast("long").alias("carry"), F.concat(acc["out"], F.array(left)).alias("out"))

        start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out"))
        limbs = F.arrays_zip(state.alias("v"), bits.alias("b"), full.alias("f"))
        return F.aggregate(limbs, start, limb)["out"]

    end = F.aggregate(F.split(word, ""), full, letter)
    return length - F.aggregate(end, F.lit(0), lambda n, v: n + F.bit_count(v))


def _edits(n: Column, m: Column, cutoff: float) -> Column:
    """Most letters that words of these lengths may lack of each other, both counted, at the cut-off; null
    where the lengths alone are too far apart."""
    most = F.floor((n + m) * (1 - cutoff) + 1e-9).cast("int")
    most = most - F.pmod(most - n - m, F.lit(2))
    return F.when(most >= F.abs(n - m), most)


def similar_words(words: DataFrame, vocabulary: DataFrame, cutoff: float) -> DataFrame:
    """(word, v, ratio) of all pairs whose common subsequence makes up ``cutoff`` of both words or more:
    2 * common / (letters of both). ``words``: word; ``vocabulary``: v; neither holds the empty word.

    A word is cut into one piece more than letters may come or go, so one piece stands unchanged in the
    other word, moved by no more than may come or go before it: pairs meet on both lengths, the
    piece and its number, and none is lost.
    """
    low, high = cutoff / (2 - cutoff), (2 - cutoff) / cutoff
    others = lambda n: F.explode(F.sequence(F.ceil(n * low - 1e-9).cast("int"), F.floor(n * high + 1e-9).cast("int")))
    start = lambda i, n: F.floor(i * n / (F.col("d") + 1)).cast("int")
    w = task_spread(words.select("word"), "word").distinct().withColumn("n", F.length("word"))
    v = vocabulary.select("v").distinct().withColumn("m", F.length("v"))
    lengths = v.select("m").distinct()
    left = w.withColumn("m", others(F.col("n"))).join(lengths, "m").withColumn("d", _edits(F.col("n"), F.col("m"), cutoff)).filter("d is not null")
    left = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    at = start(F.col("i"), F.col("n"))
    left = left.select("word", "n", "m", "i", F.substring("word", at + 1, start(F.col("i") + 1, F.col("n")) - at).alias("piece"))
    asked = F.broadcast(w.select("n").distinct())  # a number per length
    right = v.withColumn("n", others(F.col("m"))).join(asked, "n", "left_semi").withColumn("d", _edits(F.col("n"), F.col("m"), cutoff))
    right = right.filter("d is not null").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    gone, come = (F.col("d") + F.col("n") - F.col("m")) / 2, (F.col("d") - F.col("n") + F.col("m")) / 2
    right = right.withColumn("s", F.explode(F.sequence(-gone.cast("int"), come.cast("int")))).withColumn("s", F.col("s") + start(F.col("i"), F.col("n")))
    size = start(F.col("i") + 1, F.col("n")) - start(F.col("i"), F.col("n"))
    right = right.filter((F.col("s") >= 0) & (F.col("s") + size <= F.col("m"))).select("v", "n", "m", "i", F.substring("v", F.col("s") + 1, size).alias("piece"))
    # few bytes but much work for each, so pairs are dealt out to all tasks; a change is a letter gone and one come
    # Spark sizes exploded rows far too low and would send them to every task
    pairs = left.join(right.distinct().hint("merge"), ["n", "m", "i", "piece"]).select("word", "v").filter(
        F.call_function("levenshtein", F.col("word"), F.col("v"), _edits(F.length("word"), F.length("v"), cutoff)) >= 0)
    with_bits = task_spread(pairs, "word", "v").distinct().join(v.withColumn("bits", letter_bits(F.col("v"))).hint("merge"), "v")
    ratio = 2 * common_letters(F.col("word"), F.col("m"), F.col("bits")) / (F.length("word") + F.col("m"))
    return with_bits.select("word", "v", ratio.alias("ratio")).filter(F.col("ratio") >= cutoff - 1e-12)


def closest(pairs: DataFrame) -> DataFrame:
    """(word, corrected, ratio): the most similar word of each, the first in the alphabet of those as similar."""
    best = pairs.groupBy("word").agg(F.min(F.struct((-F.col("ratio")).alias("r"), F.col("v"))).alias("b"))
    return best.select("word", F.col("b.v").alias("corrected"), (-F.col("b.r")).alias("ratio"))


def correct_typos(words: DataFrame, vocabulary: DataFrame, cutoff: float = SEARCH_CUTOFF, min_letters: int = MIN_LETTERS) -> DataFrame:
    """Closest vocabulary word for unknown words. A word that begins a vocabulary word is not unknown: it may be
    still being typed. Both have ``min_letters`` or more; shorter words only count as known."""
    known = vocabulary.select("word").distinct()
    v = known.filter(F.length("word") >= min_letters).withColumnRenamed("word", "v")
    begins = v.select(F.explode(F.transform(F.sequence(F.lit(min_letters), F.length("v")), lambda k: F.left(F.col("v"), k))).alias("word"))
    w = words.select("word").distinct().filter(F.length("word") >= min_letters).join(known.unionByName(begins).distinct().hint("merge"), "word", "left_anti")
    return closest(similar_words(w, v, cutoff))


# ------------------------------------------------------------------ search

def search(queries: DataFrame, entries: DataFrame, limit: int = 10) -> DataFrame:
    """``resolve_names``, and again with corrected words for queries none of whose entries hold every word;
    a corrected query without entries leaves the first answer. ``typed`` says which query answered."""
    first = written(resolve_names(queries, entries, limit), "search")
    full = first.filter("tier >= 2").select("query_id").distinct()
    weak = queries.join(full, "query_id", "left_anti").select("query_id", F.posexplode(tokens(F.col("query"))).alias("at", "word"))
    vocabulary = entries.select(F.explode(tokens(F.col("name"))).alias("word"))
    fixed = correct_typos(weak.select("word"), vocabulary)
    again = weak.join(fixed, "word", "left").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("corrected", "word").alias("word")))).alias("l"), F.max(F.col("corrected").isNotNull()).alias("changed"))
    again = again.filter("changed").select("query_id", F.array_join(F.col("l.word"), " ").alias("query"))
    second = written(resolve_names(again, entries, limit).join(again, "query_id"), "search")
    rest = first.join(second.select("query_id").distinct(), "query_id", "left_anti").withColumn("query", F.lit(None).cast("string"))
    return rest.unionByName(second).withColumnRenamed("query", "corrected")


# ------------------------------------------------------------------ mentions

def mentions(
    texts: DataFrame, names: DataFrame, key: str, stop_words: list[str] | tuple[str, ...] = tuple(STOP_WORDS), cutoff: float = MENTION_CUTOFF
) -> DataFrame:
    """Mentions of known names in whole texts, as word positions: (key, at, words, form, name, full_name).

    Each full name counts where it first stands; of those that overlap the longer one stays, then the
    earlier one. Elsewhere a single word of four letters or more, no stop word, means the most popular name
    with that word; one of five or more that no name has means the closest name word, if similar enough.
    ``names``: name, popularity; a form or word that several names share belongs to the most popular one,
    then to the first in the alphabet. ``key`` is unique; a text without words has no mentions.

    Names of any number of words meet texts on the one of their words that the fewest texts have, and are then
    looked up in the text itself.
    """
    n = names.select(normalize_name(F.col("name")).alias("form"), "name", "popularity").filter(F.col("form") != "")
    first = F.min(F.struct((-F.col("popularity")).alias("p"), F.col("name"))).alias("m")
    forms = n.groupBy("form").agg(first).select("form", F.col("m.name").alias("name"))
    parts = n.select(F.explode(F.array_distinct(F.split("form", " "))).alias("word"), "name", "popularity").groupBy("word").agg(first).select("word", F.col("m.name").alias("name"))

    plain = task_spread(texts.select(key, "text"), key).select(key, normalize_name(F.col("text")).alias("norm")).filter("norm != ''")
    plain = written(plain.select(key, F.concat(F.lit(" "), "norm", F.lit(" ")).alias("padded")), "texts")
    words = plain.select(key, F.explode(F.array_distinct(F.split(F.trim("padded"), " "))).alias("word"))
    known = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("texts")), "words")
    anchors = forms.select("form", "name", F.explode(F.array_distinct(F.split("form", " "))).alias("word")).join(known, "word", "left")
    # a name with a word that no text has is in none
    anchors = anchors.groupBy("form", "name").agg(F.min(F.struct("texts", "word")).alias("a"), F.max(F.col("texts").isNull()).alias("absent")).filter("not absent")
    anchors = anchors.select(F.col("a.word").alias("word"), "form", "name", F.lit(True).alias("full_name"))
    lone = known.filter((F.length("word") >= MIN_LETTERS) & ~F.col("word").isin(list(stop_words))).select("word")
    exact = lone.join(parts, "word").select("word", F.col("word").alias("form"), "name", F.lit(False).alias("full_name"))
    unknown = lone.filter(F.length("word") >= MIN_LETTERS_TYPO).join(parts, "word", "left_anti")
    typed = closest(similar_words(unknown, parts.filter(F.length("word") >= MIN_LETTERS).select(F.col("word").alias("v")), cutoff))
    typed = typed.select("word", F.col("corrected").alias("form")).join(parts.withColumnRenamed("word", "form"), "form").select("word", "form", "name", F.lit(False).alias("full_name"))
    wanted = written(anchors.unionByName(exact).unionByName(typed), "wanted")

    per_text = words.join(wanted, "word").groupBy(key).agg(
        F.collect_list(F.when(F.col("full_name"), F.struct("form", "name"))).alias("full"), F.map_from_entries(F.collect_list(F.when(~F.col("full_name"), F.struct("word", F.struct("form", "name").alias("means"))))).alias("lone"))
    t = task_spread(plain, key).join(task_spread(per_text, key), key)
    padded = F.col("padded")
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))

    def found(x: Column) -> Column:
        return F.struct(F.instr(padded, F.concat(F.lit(" "), x["form"], F.lit(" "))).alias("place"), x["form"].alias("form"), x["name"].alias("name"))

    def span(x: Column) -> Column:
        at, words = spaces(F.left(padded, x["place"])) - 1, spaces(x["form"]) + 1
        return F.struct((-F.length(x["form"])).alias("l"), at.alias("at"), x["form"].alias("form"), words.alias("words"), x["name"].alias("name"))

    spans = F.array_sort(F.transform(F.filter(F.transform("full", found), lambda x: x["place"] > 0), span))
    meets = lambda a, at, words: (a["at"] < at + words) & (at < a["at"] + a["words"])
    none = F.filter(spans, lambda x: F.lit(False))
    t = t.withColumn("spans", spans).withColumn(
        "spans", F.aggregate("spans", none, lambda kept, x: F.when(F.exists(kept, lambda c: meets(c, x["at"], x["words"])), kept).otherwise(F.concat(kept, F.array(x)))))
    full = F.transform("spans", lambda x: F.struct(x["at"].alias("at"), x["words"].alias("words"), x["form"].alias("form"), x["name"].alias("name"), F.lit(True).alias("full_name")))
    single = F.transform(F.split(F.trim("padded"), " "), lambda w, i: F.struct(i.alias("at"), F.try_element_at("lone", w).alias("hit")))
    single = F.filter(single, lambda x: x["hit"].isNotNull() & ~F.exists("spans", lambda c: meets(c, x["at"], F.lit(1))))
    single = F.transform(single, lambda x: F.struct(x["at"].alias("at"), F.lit(1).alias("words"), x["hit"]["form"].alias("form"), x["hit"]["name"].alias("name"), F.lit(False).alias("full_name")))
    return t.select(key, F.inline(F.concat(full, single)))


def mentioned_names(found: DataFrame, key: str, limit: int = 2) -> DataFrame:
    """(key, rank_no, name): the first ``limit`` different names of every text, in the order they appear."""
    first = found.groupBy(key, "name").agg(F.min("at").alias("at"))
    lists = first.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "name"))), 1, limit).alias("l"))
    return lists.select(key, F.posexplode("l.name").alias("rank_no", "name")).withColumn("rank_no", F.col("rank_no") + 1)
