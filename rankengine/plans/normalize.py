"""Raw tables to dimensions and `scored_input`, one row for each run with its board, time and players."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import first_per_key, latest_per_key
from ..operators.storage import staged

Tables = dict[str, DataFrame]
#: Seconds that push a run behind all others when it lacks the board's timer. Fixed value.
PENALTY = 10_000_000.0
GUEST_ID_LENGTH = 38
DIMENSIONS = ("raw_games", "raw_categories", "raw_levels", "raw_variables", "raw_values", "raw_series", "raw_platforms", "raw_areas", "raw_colors", "raw_players")


class Current(dict):
    """Raw tables whose dimensions have the latest rows only, as `current` writes them."""

    def __or__(self, other: Tables) -> Tables:
        both = dict(self) | other
        return both if set(other) & set(DIMENSIONS) else Current(both)


def current(raw: Tables) -> Tables:
    """`raw` with the latest rows of its dimensions and with its checkpoint, written once. So each is reduced once, and joins
    know its size: small ones are broadcast by Spark's own threshold, others are shuffled."""
    if isinstance(raw, Current):
        return raw

    def write(name: str) -> DataFrame:
        return staged(latest(raw, name) if name in DIMENSIONS else raw[name], name)

    names = (*DIMENSIONS, "crawl_checkpoint")
    with ThreadPoolExecutor(4) as pool:
        return Current(raw | dict(zip(names, pool.map(write, names), strict=True)))


def latest(raw: Tables, name: str) -> DataFrame:
    """The latest rows of a dimension. Where they are written, they are read as they are: after another aggregate Spark would
    judge a small table by its shuffled rows, many times the file, and shuffle all runs to join it."""
    return raw[name] if isinstance(raw, Current) else latest_per_key(raw[name], "id")


def players_dim(raw: Tables) -> DataFrame:
    """Players with country, flag and name colours. Areas and colours are dimensions of a few thousand rows."""
    areas = latest(raw, "raw_areas").select(F.col("id").alias("area_id"), F.col("lb_flag").alias("flag"))
    colors = latest(raw, "raw_colors")
    shade = lambda n: colors.select(F.col("id").alias(f"color{n}_id"), F.col("dark").alias(f"color{n}"))
    people = latest(raw, "raw_players").join(areas, "area_id", "left").join(shade(1), "color1_id", "left").join(shade(2), "color2_id", "left")
    first = F.split_part("area_id", F.lit("/"), F.lit(1))
    return people.select("id", "name", "url", "area_id", F.when(first != "", first).alias("country"), "flag", "color1", "color2", (F.length("id") == GUEST_ID_LENGTH).alias("is_guest"))


def subcategory_values(raw: Tables) -> DataFrame:
    """Values whose variable names boards: a sub-category that isn't archived."""
    variables = latest(raw, "raw_variables").where("is_subcategory and not archived").select(F.col("id").alias("variable_id"))
    return latest(raw, "raw_values").join(variables, "variable_id", "left_semi").select("id", "name")


def completed_runs(raw: Tables) -> DataFrame:
    """Runs of completed games, each run id once: its first row. A run comes again with a later crawl, seldom in one task's
    rows, so these are dealt by run before they are sorted."""
    done = raw["crawl_checkpoint"].where("status = 'done'").select("game_id")
    return first_per_key(raw["raw_runs"].join(done, "game_id", "left_semi").repartition("run_id"), ["run_id"], [F.col("ord").asc()])


def value_texts(runs: DataFrame, values: DataFrame) -> DataFrame:
    """(value_ids, subcat_text) of each distinct list in `runs` with a sub-category value: their names in order.

    Lists repeat from run to run, so they are made distinct first: what is exploded and joined grows with the lists, and
    a value that many runs have is no hot key.
    """
    each = runs.select("value_ids").distinct().select("value_ids", F.posexplode("value_ids").alias("pos", "id")).join(values, "id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return each.groupBy("value_ids").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ", ").alias("subcat_text"))


def subcategory_text(runs: DataFrame, values: DataFrame) -> DataFrame:
    """(run_id, subcat_text); only runs that have sub-category values."""
    return runs.select("run_id", "value_ids").join(value_texts(runs, values), "value_ids").select("run_id", "subcat_text")


def chosen_time(timer: Column) -> tuple[Column, Column]:
    """The run's time by the game's timer (0: real time, 1: with loads, 2: in game), and whether that timer is missing."""
    real, loads, game = F.col("time"), F.col("time_with_loads"), F.col("igt")
    late = game + F.lit(PENALTY)
    t = F.when(timer == 1, F.coalesce(loads, real, late)).when(timer == 2, F.coalesce(game, real, loads)).otherwise(F.coalesce(real, loads, late))
    own = F.when(timer == 1, loads).when(timer == 2, game).otherwise(real)
    return t, own.isNull()


def scored_input(raw: Tables) -> DataFrame:
    games = latest(raw, "raw_games").select(F.col("id").alias("game_id"), F.col("name").alias("game"), "default_timer")
    categories = latest(raw, "raw_categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"), "time_direction")
    levels = latest(raw, "raw_levels").select(F.col("id").alias("level_id"), F.col("name").alias("level"))
    texts = staged(value_texts(raw["raw_runs"], subcategory_values(raw)), "value-texts")
    # a text instead of its values and one time instead of three, before rows are shuffled for the first of each run
    t, missing = chosen_time(F.col("default_timer"))
    narrow = raw["raw_runs"].join(texts, "value_ids", "left").join(games.select("game_id", "default_timer"), "game_id", "left")
    narrow = narrow.select("ord", "run_id", "game_id", "category_id", "level_id", "subcat_text", "player_ids", "platform_id", t.alias("t"), missing.alias("missing"), "date", "date_submitted")
    rows = completed_runs(raw | {"raw_runs": narrow}).join(games.drop("default_timer"), "game_id").join(categories, "category_id").join(levels, "level_id", "left")
    # a level that isn't known makes the whole name null
    level = F.when(F.col("level_id").isNotNull(), F.concat(F.lit(", "), "level")).otherwise("")
    subs = F.when(F.col("subcat_text").isNotNull(), F.concat(F.lit(" - "), "subcat_text")).otherwise("")
    return rows.select(
        "ord", "run_id", "game_id", "platform_id", "player_ids",
        F.concat("game", F.lit(": "), "category", level, subs).alias("leaderboard_name"),
        (F.col("time_direction") == 1).alias("is_reverse"),
        "t", F.col("missing").alias("missing_primary"),
        F.coalesce("date", F.lit(0)).alias("date"), F.coalesce("date_submitted", F.lit(2147483647)).alias("date_submitted"),
        F.col("level_id").isNotNull().alias("is_level_run"),
    )
