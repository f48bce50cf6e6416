"""Names, mentions and similarity: tiered name resolution, typos, spans, vectors, linkage."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.ordered import top_n
from touchline.functions.words import normalize_name
from touchline.session import written

# Vector features with their ranges, words of positions
VECTOR_FEATURES = (
    ("total_points", 0, 300), ("goals_scored", 0, 30), ("assists", 0, 20), ("clean_sheets", 0, 20), ("bonus", 0, 50), ("bps", 0, 1000),
    ("minutes", 0, 3500), ("ict_index", 0, 15), ("influence", 0, 100), ("creativity", 0, 100), ("threat", 0, 100), ("value", 40, 150),
    ("form", 0, 10), ("selected", 0, 5000000),
)
POSITION_WORDS = {"GK": "goalkeeper", "DEF": "defender", "MID": "midfielder", "FWD": "forward"}
PARTICLES = ("de", "da", "van", "el")
MIN_NAME_WITH_MINUTES, MIN_NAME_ONLY, MIN_AGREEMENT, MINUTES_TOLERANCE = 60, 90, 0.6, 3


def tokens(col: Column) -> Column:
    return F.filter(F.split(normalize_name(col), " "), lambda t: t != "")


# ------------------------------------------------------------------ names

def resolve_names(queries: DataFrame, entries: DataFrame, limit: int = 10) -> DataFrame:
    """Best entries for each typed query: 4 exact, 3 every word starts a name word in order,
    2 every word lies inside the name, 1 some do; popularity breaks ties and tier 1 only shows
    when nothing better exists. ``queries``: query_id, query; ``entries``: entry_id, name, popularity.

    Equal queries are answered once. An entry that holds every word is found on the query's rarest word. Of
    one-word queries and of a weak query's most frequent word, the ``limit`` most popular entries of every name word
    stand for all of them: as many others would come before any further one.
    """
    order = [F.col("popularity").desc(), F.col("entry_id")]
    asked = queries.select("query_id", normalize_name(F.col("query")).alias("q"))
    split = F.filter(F.split("q", " "), lambda t: t != "").alias("qt")
    q = written(asked.select("q").distinct().select("q", split), "queries")
    e = entries.filter(F.col("entry_id").isNotNull()).select("entry_id", "name", "popularity", normalize_name(F.col("name")).alias("n"), tokens(F.col("name")).alias("nt"))
    e = written(e, "entries")
    ew = e.select("entry_id", "popularity", F.explode(F.array_distinct("nt")).alias("nw"))
    qw = q.select("q", F.size("qt").alias("len"), F.explode(F.array_distinct("qt")).alias("qw"))
    counts = ew.groupBy("nw").agg(F.count(F.lit(1)).alias("held"))
    # short words must start the name word, longer ones may lie inside it
    sought = qw.select("qw").distinct()
    pieces = _pieces(counts, "nw", sought, "qw").filter((F.length("piece") >= 3) | F.startswith("nw", F.col("piece")))
    words = written(_meet(pieces.withColumnRenamed("piece", "qw"), sought, "qw").select("qw", "nw", "held"), "words")
    held = _meet(qw, words.groupBy("qw").agg(F.sum("held").alias("held")), "qw", "left")
    per = held.groupBy("q", "len").agg(F.min(F.struct("held", "qw")).alias("rare"), F.max(F.struct("held", "qw")).alias("often"), F.max(F.col("held").isNull()).alias("lacks"))
    top = lambda asked: _meet(_meet(asked, words, "qw").select("q", "nw"), top_n(_meet(ew, sought_names, "nw"), ["nw"], order, limit), "nw").select("q", "entry_id")
    every = lambda asked: _meet(_meet(asked, words, "qw").select("q", "nw").distinct(), ew, "nw").select("q", "entry_id")
    sought_names = words.select("nw").distinct()
    full = per.filter("not lacks").select("q", "len", F.col("rare.qw").alias("qw"))
    exact = _meet(q.filter(F.size("qt") > 0).select("q"), e.select(F.col("n").alias("q"), "entry_id"), "q")
    hit = every(full.filter("len > 1")).unionByName(top(full.filter("len = 1"))).unionByName(exact)
    best = written(_ranked(hit, q, e, limit).filter("tier >= 2"), "full")
    weak = _meet(_meet(held.filter("held is not null"), best.select("q").distinct(), "q", "left_anti"), per.select("q", "often"), "q")
    often = F.col("qw") == F.col("often.qw")
    rest = _ranked(every(weak.filter(~often)).unionByName(top(weak.filter(often))), q, e, limit)
    # the answers of a query text are ranked, so an id that asks once takes them as they are
    answers = written(best.unionByName(rest), "answers")
    ids = asked.filter("query_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("__n"), F.min("q").alias("q"))
    cols = ["query_id", "entry_id", "name", "tier", "matched", "rank_no"]
    once = _meet(ids.filter("__n = 1"), answers, "q").select(*cols)
    c = _meet(_meet(asked, ids.filter("__n > 1").select("query_id"), "query_id"), answers.drop("rank_no"), "q").drop("q")
    first = c.groupBy("query_id").agg(F.max("tier").alias("__t"))
    c = _meet(c, first, "query_id").filter((F.col("__t") < 2) | (F.col("tier") >= 2))
    return once.unionByName(top_n(c, ["query_id"], [F.col("tier").desc(), F.col("matched").desc(), *order], limit).select(*cols))


def _meet(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that sends neither side to every task: Spark sizes rows that were exploded, and packed files, far too low."""
    return a.join(b.hint("merge"), on, how)


def _ranked(hit: DataFrame, q: DataFrame, e: DataFrame, limit: int) -> DataFrame:
    """(q, entry_id, name, popularity, tier, matched): the best ``limit`` of the entries that may answer a query."""
    c = _meet(_meet(hit.distinct(), q, "q"), e, "entry_id")
    starts = lambda w: F.exists("nt", lambda t: F.startswith(t, w))
    inside = lambda w: F.exists("nt", lambda t: F.startswith(t, w) | ((F.length(w) >= 3) & F.contains(t, w)))
    n_in = F.size(F.filter("qt", inside))
    # words in order: walk the query, each word must start a name word behind the last one used
    walk = F.aggregate("qt", F.lit(0), lambda at, w: F.when(at < 0, at).otherwise(F.coalesce(
        F.array_min(F.filter(F.transform("nt", lambda t, i: F.when(F.startswith(t, w) & (i >= at), i + 1)), lambda i: i.isNotNull())), F.lit(-1))))
    total = F.size("qt")
    tier = (
        F.when(F.col("n") == F.col("q"), 4).when((F.size(F.filter("qt", starts)) == total) & (walk > 0), 3)
        .when(n_in == total, 2).otherwise(1)
    )
    c = c.withColumns({"tier": tier, "matched": F.when(F.col("n") == F.col("q"), total).otherwise(n_in)})
    order = [F.col("tier").desc(), F.col("matched").desc(), F.col("popularity").desc(), F.col("entry_id")]
    return top_n(c, ["q"], order, limit).select("q", "entry_id", "name", "popularity", "tier", "matched", "rank_no")


def _pieces(df: DataFrame, text: str, sought: DataFrame, name: str) -> DataFrame:
    """Rows with every different piece of ``text`` that is as long as a name of ``sought``."""
    lengths = sought.filter(F.col(name) != "").agg(F.collect_set(F.length(name)).alias("__l")).withColumn("__one", F.lit(1))  # a number per length
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, n))
    pieces = F.flatten(F.transform(F.filter("__l", lambda n: n <= F.length(text)), cut))
    return df.withColumn("__one", F.lit(1)).join(lengths, "__one").select(*df.columns, F.explode(F.array_distinct(pieces)).alias("piece"))


def match_clubs(source: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """Source club names to ours: alias, then exact, then one contained in the other."""
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(normalize_name(F.col(c)), r"\b(a?fc)\b", ""), " +", " "))
    s = source.select("source").distinct().withColumn("n", norm("source"))
    t = teams.select("team").distinct().withColumn("m", norm("team"))
    a = s.join(aliases.select(F.col("alias").alias("n"), "team"), "n").join(t.select("team"), "team", "left_semi").select("source", "team", F.lit(1).alias("tier"))
    b = s.join(t, s["n"] == t["m"]).select("source", "team", F.lit(2).alias("tier"))
    # one row per piece of a name: the first team is the one that counts
    inside = s.join(_pieces(t, "m", s, "n").groupBy(F.col("piece").alias("n")).agg(F.min("team").alias("team")), "n").select("source", "team")
    held = t.filter(F.col("m") != "").groupBy(F.col("m").alias("piece")).agg(F.min("team").alias("team"))
    around = _pieces(s, "n", t, "m").join(held, "piece").select("source", "team")
    c = inside.unionByName(around).withColumn("tier", F.lit(3))
    return top_n(a.unionByName(b).unionByName(c), ["source"], [F.col("tier"), F.col("team")], 1).select("source", "team", "tier")


def pair_matches(source: DataFrame, ours: DataFrame, days: int = 2) -> DataFrame:
    """Our match for each source match: same clubs and sides, kick-offs within ``days``. Matches meet on
    the slot of ``days`` days they start in, or a neighbouring one, not on the clubs alone."""
    slot = lambda c: F.floor(F.unix_timestamp(c) / (days * 86400))
    s = source.select(F.col("id").alias("source_id"), "home_team", "away_team", F.col("kickoff_time").alias("__t"))
    s = s.withColumn("slot", F.explode(F.sequence(slot("__t") - 1, slot("__t") + 1)))
    o = ours.select("id", "home_team", "away_team", "kickoff_time", slot("kickoff_time").alias("slot"))
    j = s.join(o, ["home_team", "away_team", "slot"]).drop("slot")
    gap = F.abs(F.unix_timestamp("kickoff_time") - F.unix_timestamp("__t"))
    return top_n(j.withColumn("gap", gap).filter(F.col("gap") <= days * 86400), ["source_id"], [F.col("gap"), F.col("id")], 1).select("source_id", "id", "gap")


# ------------------------------------------------------------------ vectors

def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def similar_to(items: DataFrame, query: Sequence[float], k: int, id_col: str, vec: str, where: Column | None = None) -> DataFrame:
    """Items most similar to one vector, optionally filtered."""
    d = items if where is None else items.filter(where)
    ref = F.lit([float(x) for x in query])
    return d.select(id_col, F.round(cosine(F.col(vec), ref), 6).alias("similarity")).orderBy(F.col("similarity").desc(), id_col).limit(k)


def similar_to_item(items: DataFrame, item: int, k: int, id_col: str, vec: str) -> DataFrame:
    """Items most similar to a given one, itself left out; its vector is looked up and then a constant
    of the scan. Without the item there is no result."""
    found = items.filter(F.col(id_col) == item).select(vec).first()
    others = items.filter(F.col(id_col) != item) if found and found[0] is not None else items.limit(0)
    return similar_to(others, found[0] if found and found[0] is not None else [0.0], k, id_col, vec)


def numeric_vector(df: DataFrame) -> DataFrame:
    """Fourteen statistics scaled to 0..1; missing ones count as 0."""
    def scale(c: str, lo: float, hi: float) -> Column:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))

    return df.withColumn("vector", F.array(*[scale(*f) for f in VECTOR_FEATURES]))


def describe(df: DataFrame) -> DataFrame:
    """A sentence about each player-season, built from its numbers."""
    n = lambda c: F.col(c).cast("string")
    one = lambda c: F.format_string("%.1f", F.round(F.round(c, 10), 1))
    g = F.col("games")
    ppg = F.col("total_points") / g
    word = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in POSITION_WORDS.items() for x in kv]), F.col("position")), F.lit("player"))
    attack = F.concat(F.lit("with "), n("goals_scored"), F.lit(" goals and "), n("assists"), F.lit(" assists"))
    defend = F.concat(F.lit("keeping "), n("clean_sheets"), F.lit(" clean sheets and providing "), n("assists"), F.lit(" assists"))
    keep = F.concat(F.lit("with "), n("clean_sheets"), F.lit(" clean sheets and "), n("saves"), F.lit(" saves"))
    back = F.col("position").isin("GK", "DEF")
    parts = [
        F.concat(F.col("name"), F.lit(" is a Premier League "), word),
        F.when(F.col("team").isNotNull(), F.concat(F.lit("playing for "), F.col("team"))),
        F.concat(F.lit("in the "), F.col("season"), F.lit(" season")),
        F.concat(F.lit("who scored "), n("total_points"), F.lit(" FPL points")),
        F.when(g > 0, F.concat(F.lit("averaging "), one(ppg), F.lit(" points per game over "), n("games"), F.lit(" appearances"))),
        F.when(g > 0, F.when(ppg >= 6, "delivering elite returns").when(ppg >= 4.5, "delivering strong returns")),
        F.when(F.col("position").isin("FWD", "MID"), attack).when(F.col("position") == "DEF", defend).when(F.col("position") == "GK", keep),
        F.when(back & (F.col("goals_conceded") > 0), F.concat(F.lit("conceding "), n("goals_conceded"), F.lit(" goals"))),
        F.when(F.col("bonus") > 0, F.concat(F.lit("earning "), n("bonus"), F.lit(" bonus points"))),
        F.when(F.col("bps") > 0, F.concat(F.lit("accumulating "), n("bps"), F.lit(" BPS"))),
        F.when(F.col("red_cards") > 0, F.concat(F.lit("receiving "), n("red_cards"), F.lit(" red cards"))),
        F.when(F.col("yellow_cards") > 0, F.concat(F.lit("receiving "), n("yellow_cards"), F.lit(" yellow cards"), F.when(F.col("yellow_cards") >= 5, " (high disciplinary risk)").otherwise(""))),
        F.when(F.col("value") > 0, F.concat(F.lit("valued at £"), one(F.col("value") / 10), F.lit("m"))),
    ]
    return df.select("name", "season", F.concat_ws(", ", *parts).alias("description"))


# ------------------------------------------------------------------ linkage

def link_players(other: DataFrame, ours: DataFrame) -> DataFrame:
    """Players of another source linked one-to-one to ours per season and club, by minutes that
    agree on shared dates and by the name, or by an unambiguous name alone where one side has no
    dated minutes. ``other``: season, team, player_id, player_name, date,
    minutes; ``ours``: season, team, name, date, minutes. Pairs only form inside one club's squad
    on one date."""
    by = ["season", "team"]
    dated, played = F.col("date").isNotNull(), F.col("minutes") > 0
    o = other.filter(dated).select(*by, "player_id", "date", F.col("minutes").alias("__m"))
    p = ours.filter(played).select(*by, "name", "date", F.col("minutes").alias("__p"))
    agree = o.join(p, [*by, "date"]).groupBy(*by, "player_id", "name").agg(F.count_if(F.abs(F.col("__m") - F.col("__p")) <= MINUTES_TOLERANCE).alias("agree"))
    # names are normalised once per player, not with each pair; no number where a side has no dated minutes
    who = other.groupBy(*by, "player_id").agg(F.min("player_name").alias("player_name"), F.when(F.count_if(dated) > 0, F.count_distinct("date")).alias("__no"))
    who = who.withColumn("x", normalize_name(F.col("player_name"))).drop("player_name")
    own = ours.groupBy(*by, "name").agg(F.when(F.count_if(played) > 0, F.count_distinct(F.when(played, F.col("date")))).alias("__np"))
    own = own.withColumn("y", normalize_name(F.col("name")))
    # pairs of one squad that agree on a date; where a side has no dated minutes, those that share a word of the name
    word = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))).alias("word")
    words = lambda df, c: df.select("*", word(c))
    alike = lambda a, b: words(a, "x").join(words(b, "y"), [*by, "word"]).drop("word").distinct().withColumn("agree", F.lit(0).cast("long"))
    c = agree.filter("agree > 0").join(who, [*by, "player_id"]).join(own, [*by, "name"])
    c = c.unionByName(alike(who.filter("__no is null"), own)).unionByName(alike(who.filter("__no is not null"), own.filter("__np is null")))
    x, y = F.col("x"), F.col("y")
    sim = F.round(100 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))), 6)
    last = lambda t: F.element_at(F.split(t, " "), -1)
    c = c.withColumn("sim", F.when(last(x) == last(y), F.greatest(sim, F.lit(float(MIN_NAME_ONLY)))).otherwise(sim))
    both = F.col("__no").isNotNull() & F.col("__np").isNotNull()
    c = c.withColumn("share", F.when(both, F.col("agree") / F.greatest("__no", "__np")).otherwise(0.0))
    backed = (F.col("agree") >= 2) & (F.col("share") >= MIN_AGREEMENT) & ((F.col("sim") >= MIN_NAME_WITH_MINUTES) | ((F.col("share") >= 0.8) & (F.col("agree") >= 5)))
    named = (F.col("sim") >= MIN_NAME_ONLY) & (~both | (F.col("agree") >= 1))
    c = c.withColumns({"kind": F.when(backed, 1).when(named, 0), "score": F.when(backed, 100 * F.col("share") + F.col("sim")).otherwise(F.col("sim"))}).filter(F.col("kind").isNotNull())
    # a name alone must be the player's one best name
    rank = F.count(F.lit(1)).over(Window.partitionBy(*by, "player_id", "kind", F.round("score", 6)))
    top = F.max(F.when(F.col("kind") == 0, F.col("score"))).over(Window.partitionBy(*by, "player_id"))
    c = c.withColumns({"__same": rank, "__top": top}).filter((F.col("kind") == 1) | ((F.col("score") == F.col("__top")) & (F.col("__same") == 1)))
    order = F.struct((-F.col("kind")).alias("k"), (-F.round("score", 6)).alias("s"), "player_id", "name")
    squad = c.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("pairs"))
    kept = _one_to_one()(F.col("pairs.player_id").cast("array<string>"), F.col("pairs.name"))
    linked = squad.select(*by, "pairs", kept.alias("kept")).select(*by, F.explode(F.transform("kept", lambda i: F.get("pairs", i))).alias("x"))
    return linked.select(*by, "x.player_id", "x.name", (-F.col("x.k")).alias("kind"), (-F.col("x.s")).alias("score"))


def _one_to_one():
    """Places of the pairs of a list that no earlier kept pair shares a side with."""
    def places(a, b) -> list[int]:
        seen_a, seen_b, out = set(), set(), []
        for i, (x, y) in enumerate(zip(a, b)):
            if x not in seen_a and y not in seen_b:
                out.append(i)
                seen_a.update(() if x is None else (x,))
                seen_b.update(() if y is None else (y,))
        return out

    @F.pandas_udf("array<int>")
    def keep(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([places(a, b) for a, b in zip(left, right)], dtype=object)

    return keep


def match_event_names(events: DataFrame, players: DataFrame) -> DataFrame:
    """Our player for each event name: full name, all words, surname, any word, any shared word;
    a tier counts only when it fits exactly one player of the side. ``events``: event_id, fixture,
    team, api_name; ``players``: fixture, team, name."""
    e = events.select("event_id", "fixture", "team", tokens(F.col("api_name")).alias("w"))
    p = players.select("fixture", "team", "name", tokens(F.col("name")).alias("n")).distinct()
    j = e.join(p, ["fixture", "team"])  # one side's squad per event
    want, theirs = F.element_at("w", -1), F.element_at("n", -1)
    rest = F.filter("n", lambda t: ~t.isin(*PARTICLES))
    tests = [
        F.col("w") == F.col("n"), (F.size("w") > 1) & (F.size(F.array_except("w", "n")) == 0), want == theirs,
        F.array_contains("n", want), F.arrays_overlap("w", rest),
    ]
    tiers = F.filter(F.array(*[F.when(t, F.lit(i + 1)) for i, t in enumerate(tests)]), lambda t: t.isNotNull())
    hits = j.select("event_id", "name", F.explode(tiers).alias("tier"))
    lone = hits.groupBy("event_id", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).filter(F.col("n") == 1)
    best = lone.groupBy("event_id").agg(F.min(F.struct("tier", "name")).alias("b"))
    return events.select("event_id").join(best, "event_id", "left").select("event_id", F.col("b.name").alias("name"), F.col("b.tier").alias("tier"))


def goal_timeline(events: DataFrame, linked: DataFrame) -> DataFrame:
    """Goal events on the side they count for, with our player where one was found.
    ``events``: event_id, fixture, is_home, kind, minute, api_name."""
    home = F.col("is_home") != (F.col("kind") == "own_goal")
    return events.join(linked.select("event_id", "name"), "event_id", "left").select(
        "event_id", "fixture", F.when(home, "home").otherwise("away").alias("side"), "minute", "kind", F.coalesce("name", "api_name").alias("player"))
