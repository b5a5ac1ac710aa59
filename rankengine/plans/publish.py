"""Published tables: runs, player ranks, dimensions restricted to what has runs, meta; snapshots of them."""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import dense_ids, global_row_number
from ..operators.storage import staged
from . import normalize, quality, score

Tables = dict[str, DataFrame]
SCHEMA_VERSION = 1
#: Fixed value: the stage of a crawl that has come to its end.
LAST_STAGE = "games_crawled"
#: Days that a snapshot is fresh, so that no new crawl is published.
MIN_DAYS = 3.0
#: Each further result of a player counts for a hundredth less, down to a quarter.
DECAY, FLOOR = 0.99, 0.25
#: Columns of runs with a Bloom filter, and the distinct values of a row group it is made for (about 1.2 bytes each).
FILTERED, FILTER_VALUES = ("player_id", "leaderboard_id"), 100_000
NAMES = ("runs", "player_ranks", "games", "series", "game_series", "platforms", "areas", "players", "meta")


def full_places(decay: float = DECAY, floor: float = FLOOR) -> int | None:
    """How many of a player's results count for more than the floor; None: all."""
    return math.floor(math.log(floor) / math.log(decay) + 1e-9) + 1 if 0 < floor < 1 and 0 < decay < 1 else None


def player_points(runs: DataFrame, decay: float = DECAY, floor: float = FLOOR, keys: tuple[str, ...] = ("player_id",)) -> DataFrame:
    """The keys, player, country, flag, points.

    Only the results above the floor need their places: each task keeps that many of a player's greatest at most before
    anything is shuffled, and the rest counts by its sum, made of partial sums. So no player is too large for a task.
    """
    best = Window.partitionBy(*keys).orderBy(F.col("value").desc())
    most = full_places(decay, floor)
    named = [c for c in ("player", "country", "flag") if c in runs.columns]  # the same in all rows of a player
    ranked = runs.select(*keys, "value").withColumn("nth", F.row_number().over(best))
    ranked = ranked if most is None else ranked.where(F.col("nth") <= most)
    # equal shares are added in one order: ranked rows come sorted out of the window
    share = F.greatest(F.col("value") * F.pow(F.lit(decay), F.col("nth") - 1), F.col("value") * F.lit(floor))
    first = [F.first(c, ignorenulls=True).alias(c) for c in named]
    front = ranked.groupBy(*keys).agg(F.sum(share).alias("_front"), F.sum("value").alias("_taken"), F.count("*").alias("_n"))
    whole = runs.groupBy(*keys, *named).agg(F.sum("value").alias("_sum"), F.count("*").alias("_all"))
    if named:  # texts are hashed as keys; the first of a text is found by a sort, which has a row for each player now
        whole = whole.groupBy(*keys).agg(*first, F.sum("_sum").alias("_sum"), F.sum("_all").alias("_all"))
    rest = F.when(F.col("_all") > F.col("_n"), (F.col("_sum") - F.col("_taken")) * F.lit(floor)).otherwise(F.lit(0.0))
    return front.join(whole, list(keys)).select(*keys, *named, (F.col("_front") + rest).alias("points"))


def points_of(best: Column, totals: Column, counts: Column, decay: float = DECAY, floor: float = FLOOR) -> Column:
    """Points of one row's results: `best` holds all that may be above the floor, `totals` and `counts` are lists of the sums
    and numbers of all results. The same rule as player_points."""
    most = full_places(decay, floor)
    best = F.sort_array(best, asc=False)
    best = best if most is None else F.slice(best, 1, most)
    add = lambda a, x: a + x
    share = lambda x, i: F.greatest(x * F.pow(F.lit(decay), i), x * F.lit(floor))
    taken = F.aggregate(best, F.lit(0.0), add)
    rest = F.when(F.aggregate(counts, F.lit(0).cast("long"), add) > F.size(best), (F.aggregate(totals, F.lit(0.0), add) - taken) * F.lit(floor)).otherwise(F.lit(0.0))
    return F.aggregate(F.transform(best, share), F.lit(0.0), add) + rest


def ranked(points: DataFrame, rows: int | None = None) -> DataFrame:
    """Ranks of players with their points; `rows`: about how many there are at most."""
    # sums of doubles depend on their order, so ranks go by rounded points
    order = [F.round("points", 6).desc(), F.col("player").asc(), F.col("player_id").asc()]
    rows = global_row_number(points, order, "rank", rows)
    return rows.select(F.col("rank").cast("int").alias("rank"), "player_id", "player", "country", "flag", "points")


def player_ranks(runs: DataFrame) -> DataFrame:
    return ranked(player_points(runs), runs.count())


def _named(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "name", F.col("url").alias("slug"), F.lower("name").alias("name_lower"), F.lower("url").alias("slug_lower"), *more)


def areas(raw: Tables) -> DataFrame:
    """All areas, whether runs have them or not."""
    return normalize.latest(raw, "raw_areas").select("id", "name", "full_name", "lb_name", "lb_flag", "parent_id", (F.col("lb_flag") == F.col("id")).alias("is_country"), F.lower("id").alias("id_lower"), F.lower("name").alias("name_lower"), F.lower("lb_name").alias("lb_name_lower"))


def dimensions(raw: Tables, runs: DataFrame, players: DataFrame | None = None) -> Tables:
    """games, series, game_series, platforms, areas, players; `players`: players_dim, if it is written already."""
    has = lambda c: runs.select(F.col(c).alias("id")).distinct()
    games = _named(normalize.latest(raw, "raw_games").join(has("game_id"), "id", "left_semi"), "default_timer")
    bridge = raw["raw_game_series"].select("game_id", "series_id").distinct().join(games.select(F.col("id").alias("game_id")), "game_id", "left_semi")
    series = _named(normalize.latest(raw, "raw_series").join(bridge.select(F.col("series_id").alias("id")), "id", "left_semi"))
    bridge = bridge.join(series.select(F.col("id").alias("series_id")), "series_id", "left_semi").select("game_id", "series_id")
    people = (players or normalize.players_dim(raw)).join(has("player_id"), "id", "left_semi")
    players = people.select("id", F.col("url").alias("slug"), "name", "area_id", "country", "flag", "color1", "color2", F.lower("name").alias("name_lower"), F.lower("url").alias("slug_lower"))
    return {"games": games, "series": series, "game_series": bridge, "platforms": _named(normalize.latest(raw, "raw_platforms")), "areas": areas(raw), "players": players}


def meta(tables: Tables, scored: DataFrame, data_version: str, scraped_at: str, errored: DataFrame, published_at: datetime.datetime | None = None) -> DataFrame:
    """One row of counts; every part is one aggregate."""
    runs = tables["runs"].agg(F.count("*").alias("row_count"), F.count_distinct("leaderboard_id").alias("leaderboard_count"))
    out = runs.crossJoin(scored.agg(F.count("*").alias("raw_run_count"))).crossJoin(tables["games"].agg(F.count("*").alias("game_count"))).crossJoin(tables["players"].agg(F.count("*").alias("player_count"))).crossJoin(errored.agg(F.count("*").cast("int").alias("errored_games")))
    at = F.lit(published_at) if published_at else F.current_timestamp()
    return out.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(data_version).alias("data_version"), F.lit(scraped_at).cast("timestamp").alias("scraped_at"), at.alias("published_at"), "row_count", "raw_run_count", "game_count", "leaderboard_count", "player_count", "errored_games")


def published_runs(raw: Tables, scored: DataFrame | None = None, players: DataFrame | None = None) -> DataFrame:
    """Dealt to ranges of boards, a game's boards side by side, each board's rows by place.

    Credits are written with numbers of boards. Each board then has a head, a row with its names and its id among the boards
    that have credits, which is dealt with the credits and passes them on: so one shuffle both names and clusters the rows.
    """
    scored = normalize.scored_input(raw) if scored is None else scored
    boards = score.numbered_boards(scored)
    credits = staged(score.credits(score.value_boards(scored), boards, players or normalize.players_dim(raw), raw["excluded_players"]), "credits")
    games = normalize.latest(raw, "raw_games").select(F.col("id").alias("game_id"), F.col("name").alias("game"))
    platforms = normalize.latest(raw, "raw_platforms").select(F.col("id").alias("platform_id"), F.col("name").alias("platform"))
    heads = credits.select("number", "other_game").distinct().join(boards, "number")
    heads = heads.select("number", "other_game", F.coalesce("other_game", "main_game").alias("game_id"), F.col(score.BOARD).alias("leaderboard"))
    heads = dense_ids(staged(heads.join(games, "game_id"), "heads"), "leaderboard", "leaderboard_id")
    names = ("leaderboard", "game_id", "game", "leaderboard_id")
    heads = heads.select("number", "other_game", F.struct(F.col("leaderboard_id").cast("int").alias("leaderboard_id"), *names[:3]).alias("head"))
    rows = heads.unionByName(credits.join(platforms, "platform_id", "left"), allowMissingColumns=True).repartitionByRange("number")
    # the head comes first
    of = Window.partitionBy("number", "other_game").orderBy(F.col("head").isNull(), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", F.first("head").over(of)).where("player_id is not null").withColumns({c: F.col(f"head.{c}") for c in names})
    return rows.select("leaderboard", "game_id", "game", "player_id", "player", "country", "flag", "platform_id", "platform", "place", "value", "date", "leaderboard_id")


class UnfinishedCrawl(RuntimeError):
    """The crawl that should be published hasn't come to its end."""


def crawl_state(crawl_meta: DataFrame) -> dict[str, str]:
    """The keys of a crawl (version, started_at, stage), a few rows."""
    return {r["key"]: r["value"] for r in crawl_meta.select("key", "value").collect()}


def publish_crawl(raw: Tables, at: str | None = None) -> Tables:
    """The tables of a finished crawl, with its version and start; UnfinishedCrawl if its stage isn't the last one. `at`: see
    publish_scored."""
    state = crawl_state(raw["crawl_meta"])
    if state.get("stage") != LAST_STAGE:
        raise UnfinishedCrawl(f"the crawl {state.get('version', '')} is at the stage {state.get('stage', 'none')}")
    started = state.get("started_at") or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
    version, started = state.get("version", "v1"), started.replace("T", " ")
    return publish_scored(normalize.current(raw), version, started, at)[0] if at else publish(raw, version, started)


def snapshot_age(spark: SparkSession, root: str, now: datetime.datetime) -> float | None:
    """Days since the crawl of the snapshot published last began; None without one."""
    found = versions(spark, root)
    if not found:
        return None
    seconds = spark.read.parquet(f"{root}/version={found[-1]}/meta").select(F.unix_timestamp("scraped_at")).first()[0]
    return (now.timestamp() - seconds) / 86400


def weekly(raw: Tables, root: str, excluded: list[str], smoke_game: str, min_leaderboards: int = quality.MIN_LEADERBOARDS, min_days: float = MIN_DAYS, force: bool = False, now: datetime.datetime | None = None) -> DataFrame | None:
    """Publishes a finished crawl if the newest snapshot is old enough (or with `force`) and all gates pass. Returns the
    gates' rows, or None if it was too early."""
    spark = raw["raw_runs"].sparkSession
    age = snapshot_age(spark, root, now or datetime.datetime.now(datetime.UTC))
    if not force and age is not None and age < min_days:
        return None
    tables = publish_crawl(raw)
    return publish_checked(tables, root, tables["meta"].first()["data_version"], excluded, smoke_game, min_leaderboards)


def publish(raw: Tables, data_version: str = "v1", scraped_at: str = "2024-01-08 00:00:00") -> Tables:
    """All published tables. Dimensions, scored_input and runs, which others read, are written once to shared storage."""
    return publish_scored(normalize.current(raw), data_version, scraped_at)[0]


def publish_scored(raw: Tables, data_version: str, scraped_at: str, at: str | None = None, place: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Tables, DataFrame]:
    """All published tables, and scored_input, of raw tables with the latest rows of dimensions only. With `at`, the folder
    of a snapshot to be, runs are written to their place in it, where write_snapshot leaves them. `place` writes scored_input
    and returns the written table."""
    players = staged(normalize.players_dim(raw), "players-dim")
    scored = normalize.scored_input(raw)
    scored = place(scored) if place else staged(scored, "scored")
    runs = published_runs(raw, scored, players)
    runs = _placed(runs, "runs", at) if at else staged(runs, "runs")
    tables = {"runs": runs, "player_ranks": player_ranks(runs), **dimensions(raw, runs, players)}
    return tables | {"meta": meta(tables, scored, data_version, scraped_at, raw["crawl_checkpoint"].where("status = 'error'"))}, scored


def publish_checked(tables: Tables, root: str, version: str, excluded: list[str], smoke_game: str, min_leaderboards: int = quality.MIN_LEADERBOARDS) -> DataFrame:
    """The gates against the newest snapshot under `root`, if there is one; the new one is written only if all pass.
    Returns the gates' rows."""
    try:
        previous = read_snapshot(tables["runs"].sparkSession, root)
    except LookupError:
        previous = None
    gates = staged(quality.run_gates(tables, previous, excluded, smoke_game, min_leaderboards), "gates")
    if not gates.where("not ok").limit(1).count():
        write_snapshot(tables, root, version)
    return gates


def _placed(df: DataFrame, name: str, at: str) -> DataFrame:
    """Writes a table of the snapshot in the folder `at` and returns the written table."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    for column in FILTERED if name == "runs" else ():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(FILTER_VALUES))
    writer.parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")


def write_snapshot(tables: Tables, root: str, version: str, placed: tuple[str, ...] = ()) -> None:
    """Each table as zstd Parquet under <root>/version=<version>/<table>, meta last, but for those `placed` there already.
    Runs are clustered by game, so ranges of games are skipped by their bounds; Bloom filters let reads of a player or board
    skip the rest."""
    def write(name: str) -> None:
        df = tables[name]
        if name == "runs":
            df = df.repartitionByRange(F.col("game_id")).sortWithinPartitions("game_id", "leaderboard_id", "place")
        _placed(df, name, f"{root}/version={version}")

    with ThreadPoolExecutor(4) as pool:  # most tables are small jobs
        list(pool.map(write, [n for n in tables if n not in ("meta", *placed)]))
    write("meta")


def versions(spark: SparkSession, root: str) -> list[str]:
    """Versions with a meta table, in the order in which they were published."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/meta/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [p.getPath().toString().split("version=")[1].split("/")[0] for p in found]
    if len(names) < 2:
        return names
    metas = [spark.read.parquet(f"{root}/version={v}/meta").select("published_at", F.lit(v).alias("version")) for v in names]
    return [r["version"] for r in reduce(DataFrame.unionByName, metas).orderBy("published_at", "version").collect()]  # a row each


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> Tables:
    """The tables of `version`, or of the version published last. No version: LookupError."""
    if version is None:
        found = versions(spark, root)
        if not found:
            raise LookupError(f"no snapshot under {root}")
        version = found[-1]
    return {name: spark.read.parquet(f"{root}/version={version}/{name}") for name in NAMES}
