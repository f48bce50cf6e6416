"""Readers and adapters: files, JSON feeds and other shapes into our tables.

File readers take a path and an explicit schema; the adapters behind them work on any frame
with the same columns, so they can be used on tables as well as on files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.ordered import rolling_rows, top_n
from touchline.functions.words import normalize_name
from touchline.operators.derived import opponents

# Column names of older files, positions, price columns, formats
RENAMES = {"season_x": "season", "team_x": "team"}
POSITIONS = ("GK", "DEF", "MID", "FWD")
MANAGER_COLUMNS = ("mng_win", "mng_draw", "mng_loss", "mng_underdog_win", "mng_underdog_draw", "mng_clean_sheets", "mng_goals_scored", "modified")
PRICES = (("AvgH", "AvgD", "AvgA", "AvgOver", "AvgUnder"), ("B365H", "B365D", "B365A", "B365Over", "B365Under"))
CLOSING = (("AvgCH", "AvgCD", "AvgCA", "AvgCOver", "AvgCUnder"), ("B365CH", "B365CD", "B365CA", "B365COver", "B365CUnder"))
UK = "Europe/London"
SEASON_START_MONTH = 7

HISTORY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("season", "name", "position", "team", "kickoff_time")]
    + [T.StructField(c, T.IntegerType()) for c in ("fixture", "GW", "team_h_score", "team_a_score", "total_points", "minutes", "starts", "goals_scored", "assists", "bonus", "bps", "clean_sheets", "goals_conceded", "saves", "value", "element")]
    + [T.StructField(c, T.DoubleType()) for c in ("ict_index", "influence", "creativity", "threat", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded", "defensive_contribution", "xP")]
    + [T.StructField(c, T.LongType()) for c in ("selected", "transfers_balance", "transfers_in", "transfers_out")]
    + [T.StructField("was_home", T.BooleanType())]
)


# ------------------------------------------------------------------ appearances

def normalize_history(raw: DataFrame, season: str | None = None) -> DataFrame:
    """Any season's file in our layout: renamed columns, GKP as GK, players only, missing columns
    as nulls, UTC kick-off."""
    df = raw.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in raw.columns and b not in raw.columns})
    if season is not None:
        df = df.withColumn("season", F.lit(season))
    df = df.withColumn("position", F.when(F.col("position") == "GKP", "GK").otherwise(F.col("position")))
    df = df.filter(F.col("position").isin(*POSITIONS))
    cols = []
    for f in HISTORY_SCHEMA:
        if f.name == "kickoff_time":
            cols.append(F.to_timestamp(F.col("kickoff_time")).alias("kickoff_time"))
        elif f.name in df.columns:
            c = F.col(f.name)
            # NaN never enters the tables
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double")) if isinstance(f.dataType, T.DoubleType) else c
            cols.append(c.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_history(spark: SparkSession, history: str, live: str | None = None, live_season: str | None = None) -> DataFrame:
    """History file and the running season's file together."""
    def load(path: str) -> DataFrame:
        return spark.read.option("header", True).csv(path)

    out = normalize_history(load(history))
    if live is not None:
        out = out.unionByName(normalize_history(load(live), live_season), allowMissingColumns=True)
    return out


def with_sides_and_form(raw: DataFrame) -> DataFrame:
    """Home and away team from the side flag, manager rows out, and form (mean points of the last
    five matches of the season including this one) where missing."""
    df = raw.filter(F.col("position") != "AM")
    df = df.withColumns({
        "home_team": F.when(F.col("was_home"), F.col("team")).otherwise(F.col("opponent")),
        "away_team": F.when(F.col("was_home"), F.col("opponent")).otherwise(F.col("team")),
    })
    if "form" in df.columns:
        return df
    before = rolling_rows(df, ["name", "season"], "kickoff_time", ["fixture", "line"], {"__s": ("sum", "total_points", 4), "__n": ("count", "total_points", 4)})
    mean = (F.coalesce("__s", F.lit(0)) + F.col("total_points")) / (F.coalesce("__n", F.lit(0)) + 1)
    return before.withColumn("form", F.bround(mean, 1)).drop("__s", "__n")


def merge_new_seasons(master: DataFrame, new: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Append seasons the master does not hold; manager columns dropped, opponents rebuilt,
    required columns null-filled."""
    add = new.drop(*[c for c in MANAGER_COLUMNS if c in new.columns]).join(master.select("season").distinct(), "season", "left_anti")
    add = add.drop("opponent").join(opponents(add), ["season", "fixture", "team"], "left")
    out = master.unionByName(add, allowMissingColumns=True)
    for c in required:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def season_file_frame(df: DataFrame, season: str) -> DataFrame:
    """A single season's file in the loader's column names."""
    return df.withColumnsRenamed({"team": "team_x", "opponent": "opp_team_name"}).withColumn("season", F.lit(season))


def replace_season(master: DataFrame, new: DataFrame, season: str) -> DataFrame:
    """The master with one season replaced, in the master's columns."""
    cols = [F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in master.dtypes]
    return master.filter(F.col("season") != season).unionByName(new.withColumn("season", F.lit(season)).select(*cols))


def first_wins(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union of sources where an earlier source wins per key."""
    tagged = [f.withColumn("__src", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return top_n(out, keys, [F.col("__src"), *[F.col(c) for c in order]], 1).drop("__src", "rank_no")


def player_codes(history: DataFrame, status: DataFrame, season: str) -> DataFrame:
    """(season, element, code): the history file first, then the live status."""
    live = status.select(F.lit(season).alias("season"), "element", "code")
    return first_wins([history.select("season", "element", "code"), live], ["season", "element"], ["code"])


# ------------------------------------------------------------------ captures

def capture_rows(rows: DataFrame, season: Column, at: str, source: str) -> DataFrame:
    """Player states as capture rows, one id per capture time."""
    return rows.select(
        season.alias("season"), F.col(at).alias("captured_at"),
        F.concat(F.lit(f"{source}-"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("sha"),
        "element", "status", "chance", (F.trim(F.coalesce("news", F.lit(""))) != "").cast("int").alias("news_flag"),
    )


def all_captures(published: DataFrame, archive: DataFrame, status: DataFrame, season: str) -> DataFrame:
    """Published history, our archive and the current status in one layout."""
    return published.unionByName(capture_rows(archive, F.col("season"), "captured_at", "live")).unionByName(
        capture_rows(status, F.lit(season), "fetched_at", "status")
    )


# ------------------------------------------------------------------ odds

def season_of(day: Column) -> Column:
    """Season label of a date: July starts a new one."""
    y = F.year(day) - (F.month(day) < SEASON_START_MONTH).cast("int")
    return F.concat_ws("-", y.cast("string"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def parse_odds(raw: DataFrame, season: Column | None = None, arrival: str = "row_no") -> DataFrame:
    """Margin-free probabilities of each match. A price counts when it is above 1; the first
    price set wins cell by cell; the last row of a match is kept."""
    day = F.to_date("Date", "dd/MM/yyyy")
    out = raw.filter(F.col("HomeTeam").isNotNull() & F.col("AwayTeam").isNotNull())
    cols = []
    for suffix, sets in (("", PRICES), ("_c", CLOSING)):
        inv = []
        for i in range(5):
            got = [F.when(F.col(s[i]).try_cast("double") > 1, F.col(s[i]).try_cast("double")) for s in sets if s[i] in raw.columns]
            inv.append(1 / F.coalesce(*got) if got else F.lit(None).cast("double"))
        total = inv[0] + inv[1] + inv[2]
        cols += [(inv[i] / total).alias(f"p_{n}{suffix}") for i, n in enumerate(("home", "draw", "away"))]
        cols.append((inv[3] / (inv[3] + inv[4])).alias(f"p_over{suffix}"))
    out = out.select(
        (season if season is not None else season_of(day)).alias("season"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"),
        day.alias("date"), F.col(arrival), *cols,
    )
    return top_n(out, ["season", "home", "away"], [F.col(arrival).desc()], 1).drop("rank_no")


def parse_upcoming_odds(raw: DataFrame, division: str) -> DataFrame:
    """The upcoming-fixtures file: one division, season from the date."""
    return parse_odds(raw.filter((F.col("Div") == division) & F.col("Date").isNotNull()))


def odds_union(season_files: DataFrame, upcoming: DataFrame) -> DataFrame:
    """A match in both keeps the season file's row."""
    return first_wins([season_files, upcoming], ["season", "home", "away"])


def read_odds(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All season files of a folder; the season comes from the file name."""
    raw = spark.read.schema(schema).option("header", True).csv(folder, pathGlobFilter="E0_*.csv")
    code = F.regexp_extract(F.col("_metadata.file_path"), r"E0_(\d{4})\.csv", 1)
    label = F.concat(F.lit("20"), F.substring(code, 1, 2), F.lit("-"), F.substring(code, 3, 2))
    return parse_odds(raw.withColumn("row_no", F.col("_metadata.file_block_start")), label)


# ------------------------------------------------------------------ other competitions

def other_competitions(history: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History and live rows; the live row wins."""
    return first_wins([live, history], keys)


def club_match_rows(games: DataFrame, clubs: DataFrame) -> DataFrame:
    """One row per league club per match from a dump of games with two sides."""
    def side(a: str, b: str, home: bool) -> Column:
        return F.struct(F.col(f"{a}_club").alias("club_id"), F.col(f"{b}_club").alias("opponent"), F.lit(home).alias("was_home"),
                        F.col(f"{a}_goals").alias("goals_for"), F.col(f"{b}_goals").alias("goals_against"))

    rows = games.select("game_id", "season", "kickoff_time", F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s"))
    return rows.select("game_id", "season", "kickoff_time", "s.*").join(clubs, ["season", "club_id"])


def squads_from_lineups(lineups: DataFrame, appearances: DataFrame) -> DataFrame:
    """Squads of matches from line-ups and appearances; without a line-up 60 minutes count as a start."""
    l = lineups.select("game_id", "player_id", F.col("club_id").alias("__lc"), F.col("name").alias("__ln"), "type")
    a = appearances.select("game_id", "player_id", F.col("club_id").alias("__ac"), F.col("name").alias("__an"), F.col("minutes").alias("__m"), "goals", "assists")
    m = F.coalesce("__m", F.lit(0))
    return l.join(a, ["game_id", "player_id"], "full").select(
        "game_id", "player_id", F.coalesce("__lc", "__ac").alias("club_id"), F.coalesce("__ln", "__an").alias("name"), m.alias("minutes"),
        F.when(F.col("type").isNotNull(), (F.col("type") == "starting_lineup").cast("int")).otherwise((m >= 60).cast("int")).alias("started"),
        F.coalesce("goals", F.lit(0)).alias("goals"), F.coalesce("assists", F.lit(0)).alias("assists"),
    )


# ------------------------------------------------------------------ second-tier tables

def clean_stat_table(raw: DataFrame, season: Column | str, table: str) -> DataFrame:
    """A statistics-site table without its repeated headers, with position, name key and origin."""
    df = raw.filter(F.coalesce(F.col("Player") != "Player", F.lit(True)))
    if "Rk" in df.columns:
        df = df.filter(F.coalesce(F.col("Rk") != "Rk", F.lit(True)))
    pos = F.regexp_replace(F.trim("Pos"), " ", "")
    return df.withColumns({
        "Pos": pos, "Pos_Primary": F.element_at(F.split(pos, ","), 1), "Is_Multi_Pos": F.coalesce(F.contains(pos, F.lit(",")), F.lit(False)),
        "Player_Key": normalize_name(F.col("Player")), "Season": F.lit(season) if isinstance(season, str) else season, "Table_Type": F.lit(table),
    })


def read_stat_table(spark: SparkSession, path: str, season: str, table: str) -> DataFrame:
    return clean_stat_table(spark.read.option("header", True).option("sep", "\t").csv(path), season, table)


def file_inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Season and table type of each discovered file, from folder and file name."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    return files.select(
        p.alias("path"), F.regexp_extract(p, r"/[A-Z]+-(\d{4}-\d{4})/", 1).alias("season"),
        F.lower(F.regexp_extract(name, r"^\d{4}-\d{4}_([A-Za-z]+)_", 1)).alias("table_type"),
        F.lower(F.regexp_extract(name, r"_([A-Za-z]+)\.(?:txt|csv)$", 1)).alias("unit"),
    ).filter(F.col("season") != "")


def discover_files(spark: SparkSession, base: str) -> DataFrame:
    """Inventory of the text files below a folder, without reading their contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,csv}").load(base)
    return file_inventory(found.select("path"))


def team_tables(standard: DataFrame, keeping: DataFrame, season: str = "season") -> DataFrame:
    """Standard and goalkeeping team tables joined, per-game rates, keyed by the next season."""
    nxt = F.substring(season, 1, 4).cast("int") + 1
    label = F.concat_ws("-", nxt.cast("string"), F.lpad(F.pmod(nxt + 1, F.lit(100)).cast("string"), 2, "0"))
    mp = F.col("MP")
    return standard.select(season, "Squad", "MP", "Gls").join(keeping.select(season, "Squad", "GA", "W", "D"), [season, "Squad"]).select(
        label.alias("season"), F.col("Squad").alias("team"), (F.col("Gls") / mp).alias("efl_gf_pg"), (F.col("GA") / mp).alias("efl_ga_pg"),
        ((F.col("W") * 3 + F.col("D")) / mp).alias("efl_ppg"),
    )


def manager_events(changes: DataFrame) -> DataFrame:
    """Vacancy and appointment dates as one event per row."""
    return changes.unpivot(["team"], ["vacancy", "appointed"], "event", "date").filter(F.col("date").isNotNull())


# ------------------------------------------------------------------ fixtures

def local_to_utc(day: Column, clock: Column, zone: str = UK) -> Column:
    """Local dd/MM/yyyy date and HH:mm time to UTC, daylight saving included; no time is midnight."""
    text = F.concat_ws(" ", day, F.coalesce(clock, F.lit("00:00")))
    return F.to_utc_timestamp(F.to_timestamp(text, "dd/MM/yyyy HH:mm"), zone)


def schedule_rows(raw: DataFrame, season: str) -> DataFrame:
    """A fixture schedule file as fixture rows."""
    return raw.select(
        F.concat_ws("-", F.lit("csv"), F.lit(season), F.col("Matchday").cast("string"), F.regexp_replace("HomeTeam", " ", "_")).alias("id"),
        F.lit(season).alias("season"), F.col("Matchday").cast("int").alias("gameweek"), local_to_utc(F.col("Date"), F.col("Time")).alias("kickoff_time"),
        F.col("HomeTeam").alias("home_team"), F.col("AwayTeam").alias("away_team"), F.lit("scheduled").alias("status"),
    )


def read_schedule(spark: SparkSession, path: str, season: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return schedule_rows(raw.withColumnsRenamed({"Home Team": "HomeTeam", "Away Team": "AwayTeam"}), season)


SUMMARY_JSON = "struct<element:bigint,history:array<struct<fixture:bigint,line:bigint,round:int,was_home:boolean,minutes:int,total_points:int,value:int>>>"


def season_rows(summaries: DataFrame, fixtures: DataFrame, xp: DataFrame) -> DataFrame:
    """Nested per-player histories as appearance rows of finished matches, with the team at the
    time of the match and the forecast captured for the gameweek. ``summaries``: one JSON text per player."""
    s = summaries.select(F.from_json("json", SUMMARY_JSON).alias("j")).select("j.element", F.explode("j.history").alias("h")).select("element", "h.*")
    f = fixtures.filter(F.col("status") == "finished").select(F.col("id").alias("fixture"), "home_team", "away_team")
    return s.join(f, "fixture").join(xp.select("element", F.col("GW").alias("round"), "xP"), ["element", "round"], "left").select(
        "element", "fixture", "line", F.col("round").alias("GW"), F.when(F.col("was_home"), F.col("home_team")).otherwise(F.col("away_team")).alias("team"),
        "was_home", "minutes", "total_points", "value", "xP",
    )


STATE_JSON = "struct<id:bigint,team:int,element_type:int,status:string,chance:double,news:string,now_cost:int>"
ELEMENT_TYPES = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}


def status_rows(elements: DataFrame, teams: DataFrame) -> DataFrame:
    """Current player states from feed JSON (one player per text), players of the four positions only."""
    e = elements.select(F.from_json("json", STATE_JSON).alias("j")).select("j.*")
    pos = F.try_element_at(F.create_map(*[F.lit(x) for kv in ELEMENT_TYPES.items() for x in kv]), F.col("element_type"))
    return e.withColumn("position", pos).filter(F.col("position").isNotNull()).join(teams.select(F.col("id").alias("team"), F.col("name").alias("team_name")), "team", "left").select(
        F.col("id").alias("element"), F.col("team_name").alias("team"), "position", "status", "chance", F.coalesce("news", F.lit("")).alias("news"), "now_cost",
    )


EVENT_JSON = "struct<id:int,finished:boolean,average_entry_score:bigint,highest_score:bigint>"


def event_summaries(events: DataFrame) -> DataFrame:
    """Gameweek summaries from feed JSON; a score of 0 is one not computed yet."""
    e = events.select("season", F.from_json("json", EVENT_JSON).alias("j")).select("season", "j.*")
    return e.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in ("average_entry_score", "highest_score")})


FIXTURE_JSON = "struct<id:bigint,event:int,team_h:int,team_a:int,team_h_score:int,team_a_score:int,finished:boolean,started:boolean,kickoff_time:string>"


def fixture_rows(feed: DataFrame, teams: DataFrame) -> DataFrame:
    """Fixtures from feed JSON; scores only once finished, matches of unknown teams skipped."""
    f = feed.select("season", F.from_json("json", FIXTURE_JSON).alias("j")).select("season", "j.*")
    h = teams.select(F.col("id").alias("team_h"), F.col("name").alias("home_team"))
    a = teams.select(F.col("id").alias("team_a"), F.col("name").alias("away_team"))
    done = F.coalesce("finished", F.lit(False))
    return f.join(h, "team_h").join(a, "team_a").select(
        F.concat_ws("-", F.col("id").cast("string"), "season").alias("id"), "season", F.col("event").alias("gameweek"),
        F.when(F.col("event").isNotNull(), F.concat(F.col("season"), F.lit("-GW"), F.col("event").cast("string"))).alias("gw_id"),
        F.when(done, "finished").when(F.coalesce("started", F.lit(False)), "in_progress").otherwise("scheduled").alias("status"),
        F.when(done, F.col("team_h_score")).alias("home_score"), F.when(done, F.col("team_a_score")).alias("away_score"), "home_team", "away_team",
    )


def infer_team_names(fixtures: DataFrame, app: DataFrame) -> DataFrame:
    """Team id to name from appearance rows: the row's team is the side it played on."""
    f = fixtures.select(F.col("id").alias("fixture"), "team_h", "team_a")
    rows = app.select("fixture", "was_home", "team").distinct().join(f, "fixture")
    return rows.select(F.when(F.col("was_home"), F.col("team_h")).otherwise(F.col("team_a")).alias("id"), F.col("team").alias("name")).distinct()


# ------------------------------------------------------------------ match events and live feed

def parse_clock(clock: Column) -> tuple[Column, Column]:
    """Minute and added time of a clock like 64' or 90'+4'."""
    minute = F.regexp_extract(clock, r"^\s*(\d+)", 1)
    extra = F.regexp_extract(clock, r"\+\s*(\d+)", 1)
    return F.nullif(minute, F.lit("")).cast("int"), F.nullif(extra, F.lit("")).cast("int")


EVENTS_JSON = "struct<home:string,away:string,home_score:int,away_score:int,details:array<struct<side:string,kind:string,clock:string,player:string,club:string>>>"


def goal_rows(matches: DataFrame) -> DataFrame:
    """Goals, own goals and missed penalties of matches whose goals add up to the final score.

    A feed may list an own goal under the side it counts for or under the scorer's own side. The
    scorer's own club decides where it is given; otherwise both readings are tried and the first
    one that gives the final score is kept.
    """
    m = matches.select("id", F.from_json("json", EVENTS_JSON).alias("j")).select("id", "j.*")
    e = m.select("id", "home", "away", "home_score", "away_score", F.posexplode("details").alias("n", "d")).select("id", "home", "away", "home_score", "away_score", "n", "d.*")
    e = e.filter(F.col("side").isin("home", "away") & F.col("kind").isin("goal", "penalty", "own_goal", "missed_penalty"))
    flip = lambda c: F.when(c == "home", "away").otherwise("home")
    e = e.withColumn("reading", F.explode(F.array(F.lit(0), F.lit(1))))
    own = (
        F.when(F.col("kind") != "own_goal", F.col("side")).when(F.col("club").isNotNull(), F.col("club"))
        .when(F.col("reading") == 0, flip(F.col("side"))).otherwise(F.col("side"))
    )
    e = e.withColumn("own", own).withColumn("for_side", F.when(F.col("kind") == "own_goal", flip(F.col("own"))).otherwise(F.col("own")))
    scored = F.col("kind") != "missed_penalty"
    sums = e.groupBy("id", "reading").agg(
        F.count_if(scored & (F.col("for_side") == "home")).alias("h"), F.count_if(scored & (F.col("for_side") == "away")).alias("a"),
        F.first("home_score").alias("hs"), F.first("away_score").alias("as_"),
    )
    right = sums.filter((F.col("h") == F.col("hs")) & (F.col("a") == F.col("as_"))).groupBy("id").agg(F.min("reading").alias("reading"))
    minute, extra = parse_clock(F.col("clock"))
    return e.join(right, ["id", "reading"]).select(
        "id", "n", minute.alias("minute"), extra.alias("extra"), "kind", "player", F.when(F.col("own") == "home", F.col("home")).otherwise(F.col("away")).alias("team"),
    )


LIVE_JSON = "struct<id:bigint,stats:struct<total_points:bigint,minutes:bigint>,explain:array<struct<fixture:bigint,stats:array<struct<identifier:string,value:bigint,points:bigint>>>>>"


def live_players(feed: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Points of players with a match that has started. ``feed``: group, one player per JSON text."""
    e = feed.select("grp", F.from_json("json", LIVE_JSON).alias("j")).select("grp", "j.*")
    on = fixtures.filter(F.col("started")).select(F.col("id").alias("fixture"))
    played = e.select("grp", "id", F.explode("explain.fixture").alias("fixture")).join(on, "fixture", "left_semi").select("grp", "id").distinct()
    return e.join(played, ["grp", "id"], "left_semi").select(
        "grp", F.col("id").alias("element"), F.coalesce("stats.total_points", F.lit(0)).alias("points"), F.coalesce("stats.minutes", F.lit(0)).alias("minutes")
    )


def live_stat_rows(feed: DataFrame, fixtures: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """Per started match and player: points and the listed statistics as columns."""
    e = feed.select("grp", F.from_json("json", LIVE_JSON).alias("j")).select("grp", F.col("j.id").alias("element"), F.explode("j.explain").alias("x"))
    e = e.select("grp", "element", "x.fixture", F.explode_outer("x.stats").alias("st"))
    e = e.join(fixtures.filter(F.col("started")).select(F.col("id").alias("fixture")), "fixture", "left_semi")
    return e.groupBy("grp", "fixture", "element").agg(
        F.coalesce(F.sum("st.points"), F.lit(0)).alias("points"), *[F.max(F.when(F.col("st.identifier") == i, F.col("st.value"))).alias(i) for i in identifiers]
    )
