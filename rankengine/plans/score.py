"""Board places, the value formula and credits.

All board work partitions by the board's name, so one shuffle serves every window: totals and records before runs are
reduced to one for each player list, sizes, places and the median after. Boards with more than HOT_ROWS rows, which would
be too much for one task, get the same columns from sorted ranges of rows and aggregates instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_away
from ..operators.ranking import RANGE_ROWS, dense_ids, first_per_key, global_row_number
from ..operators.storage import staged
from .normalize import PENALTY

BOARD = "leaderboard_name"
#: Fixed values of the formula.
LEVEL_FACTOR = 0.75
#: Rows of a board that one task's windows take.
HOT_ROWS = 1 << 20


def _order() -> list[Column]:
    return [F.col(c).asc() for c in ("ranked_time", "date", "date_submitted", "ord")]


def timed_runs(scored: DataFrame) -> DataFrame:
    """Runs with a time, with `signed` and, with the penalty for a missing timer, `ranked_time`; runs without a board name are out."""
    signed = F.when(F.col("is_reverse"), -F.col("t")).otherwise(F.col("t"))
    rows = scored.where(F.col("t").isNotNull() & F.col(BOARD).isNotNull()).withColumn("signed", signed)
    return rows.withColumn("ranked_time", F.col("signed") + F.when(F.col("missing_primary"), F.lit(PENALTY)).otherwise(0.0))


def _halves(scored: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Timed runs of usual boards, and those of boards with too many rows for one task, if there are any; `scored` is read
    twice, so it should be written."""
    rows = scored.where(F.col("t").isNotNull() & F.col(BOARD).isNotNull())
    hot = staged(rows.groupBy(BOARD).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(BOARD), "hot-boards")
    if not hot.limit(1).count():
        return rows, None
    return rows.join(hot, BOARD, "left_anti"), timed_runs(rows.join(hot, BOARD, "left_semi"))


def _with_records(rows: DataFrame) -> DataFrame:
    """Adds is_record and the board's timed_runs_seen and num_records, by windows.

    An improvement is a dated run that beats all dated runs before it; the penalty for a missing timer doesn't enter.
    """
    rows = timed_runs(rows.repartition(F.col(BOARD)))  # what can be derived isn't shuffled
    dated = F.col("date") > 0
    walk = Window.partitionBy(BOARD).orderBy(F.when(dated, 0).otherwise(1), "date", "date_submitted", "ord").rowsBetween(Window.unboundedPreceding, -1)
    board = Window.partitionBy(BOARD)
    rows = rows.withColumn("best_before", F.min(F.when(dated, F.col("signed"))).over(walk))
    record = dated & (F.col("best_before").isNull() | (F.col("signed") < F.col("best_before")))
    return rows.withColumn("is_record", record).withColumn("timed_runs_seen", F.count("*").over(board)).withColumn("num_records", F.count_if("is_record").over(board)).drop("best_before")


def _records_by_ranges(rows: DataFrame) -> DataFrame:
    """(board, num_records) of the boards that have dated runs: the best before a row is the best of earlier ranges and of
    earlier rows of its range."""
    walk = [F.col(c).asc() for c in (BOARD, "date", "date_submitted", "ord")]
    dated = rows.where("date > 0").select(BOARD, "date", "date_submitted", "ord", "signed")
    ranged = staged(dated.repartitionByRange(dated.count() // RANGE_ROWS + 1, *walk).withColumn("_range", F.spark_partition_id()), "walk")
    earlier = lambda w: F.min("best").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bests = ranged.groupBy(BOARD, "_range").agg(F.min("signed").alias("best"))
    bests = bests.select(BOARD, "_range", earlier(Window.partitionBy(BOARD).orderBy("_range")).alias("_far"))
    near = F.min("signed").over(Window.partitionBy("_range", BOARD).orderBy(*walk).rowsBetween(Window.unboundedPreceding, -1))
    best = F.least("_far", "_near")  # skips nulls
    return ranged.withColumn("_near", near).join(bests, [BOARD, "_range"]).groupBy(BOARD).agg(F.count_if(best.isNull() | (F.col("signed") < best)).alias("num_records"))


def record_counts(scored: DataFrame) -> DataFrame:
    """(board, record_count): record improvements of each board with dated runs."""
    usual, hot = _halves(scored)
    out = _with_records(usual).where("date > 0").groupBy(BOARD).agg(F.count_if("is_record").alias("record_count"))
    return out.unionByName(_records_by_ranges(hot).withColumnRenamed("num_records", "record_count")) if hot else out


def _middle() -> Column:
    return F.floor((F.col("entries") - 1) / 2) + 1


def _places(rows: DataFrame) -> DataFrame:
    """Places by windows: all over one partitioning by board."""
    rows = _with_records(rows)
    best = Window.partitionBy(BOARD, "player_ids").orderBy(*_order())
    rows = rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "is_record")
    board = Window.partitionBy(BOARD)
    rows = rows.withColumns(
        {
            "standing": F.row_number().over(board.orderBy(*_order())).cast("long"),
            "place": F.rank().over(board.orderBy(F.col("ranked_time").asc())).cast("long"),
            "entries": F.count("*").over(board),
        }
    )
    return rows.withColumn("middle", F.max(F.when(F.col("standing") == _middle(), F.col("t"))).over(board))


def _places_by_ranges(rows: DataFrame) -> DataFrame:
    """The same columns without windows over boards: best runs by partial aggregates, places from a numbering of all rows
    by board and order, what belongs to a board or tie by aggregates and joins."""
    totals = rows.groupBy(BOARD).agg(F.count("*").alias("timed_runs_seen")).join(_records_by_ranges(rows), BOARD, "left").fillna(0, ["num_records"])
    keys = [BOARD, "player_ids"]
    lead = ["ranked_time", "date", "date_submitted", "ord"]
    rest = [c for c in rows.columns if c not in keys + lead]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*lead, *rest)).alias("x")).select(*keys, "x.*")
    numbered = global_row_number(best, [F.col(BOARD).asc(), *_order()], "_n")
    starts = numbered.groupBy(BOARD).agg(F.min("_n").alias("_first"), F.count("*").alias("entries"))
    placed = numbered.join(starts, BOARD).withColumn("standing", F.col("_n") - F.col("_first") + 1)
    ties = placed.groupBy(BOARD, "ranked_time").agg(F.min("standing").alias("place"))
    middle = placed.where(F.col("standing") == _middle()).select(BOARD, F.col("t").alias("middle"))
    return placed.join(ties, [BOARD, "ranked_time"]).join(totals, BOARD).join(middle, BOARD).drop("_n", "_first")


def board_places(scored: DataFrame) -> DataFrame:
    """One row for each board and ordered player list: the best run, its unique and shared place and the board's size."""
    usual, hot = _halves(scored)
    return _places(usual).unionByName(_places_by_ranges(hot)) if hot else _places(usual)


def with_stats(places: DataFrame) -> DataFrame:
    """Adds minutes (minutes of the lower-middle run), length_factor, record value and shape factor of the board."""
    n, total, records = (F.col(c).cast("double") for c in ("entries", "timed_runs_seen", "num_records"))
    length = (F.col("middle") % F.lit(PENALTY)) / F.lit(60.0)
    weight = F.lit(1.1) - F.pow(F.lit(1.01), -(F.col("minutes") + F.lit(200.0))) - F.pow(F.lit(2.4), -(F.col("minutes") + F.lit(1.2)))
    effort = (F.log(total) / F.log(F.lit(1.7))) * records + F.lit(120.0) * F.exp(F.lit(-100.0) / total) + F.lit(0.04) * total
    value = effort * (F.lit(1.0) - (records + 1.0) / (total + n)) * F.col("length_factor")
    shape = F.when(F.col("entries") > 2, (F.log(n) / F.log(F.lit(10.0))) / n + F.lit(0.001)).otherwise(F.lit(0.2))
    return places.withColumn("minutes", length).withColumn("length_factor", weight).withColumn("top_worth", value).withColumn("shape", shape)


def board_stats(places: DataFrame) -> DataFrame:
    """One row for each board."""
    return with_stats(places).select(BOARD, "timed_runs_seen", "entries", F.col("num_records").alias("record_count"), "minutes", "length_factor", "top_worth", "shape").dropDuplicates([BOARD])


def _nominal(places: DataFrame) -> DataFrame:
    rows = with_stats(places)
    n, p = F.col("entries"), F.col("standing")
    value = F.col("shape") * F.col("top_worth") * (n + 1 - p) / (p + (F.col("shape") * n - F.lit(1.0)))
    return rows.withColumn("standing_worth", value * F.when(F.col("is_level_run"), F.lit(LEVEL_FACTOR)).otherwise(F.lit(1.0)))


def value_boards(scored: DataFrame) -> DataFrame:
    """Places, stats, the value at each unique place and its mean over a tie (worth)."""
    usual, hot = _halves(scored)
    # rows of one place are those of one time, which lie together by now: no other sort
    tie = Window.partitionBy(BOARD).orderBy(F.col("ranked_time").asc()).rangeBetween(Window.currentRow, Window.currentRow)
    out = _nominal(_places(usual)).withColumn("worth", F.avg("standing_worth").over(tie))
    if hot is None:
        return out
    rows = staged(_nominal(_places_by_ranges(hot)), "hot-places")
    means = rows.groupBy(BOARD, "place").agg(F.avg("standing_worth").alias("worth"))
    return out.unionByName(rows.join(means, [BOARD, "place"]))


def _known(players: DataFrame, excluded: DataFrame) -> DataFrame:
    """Players who are credited: named, neither guests nor excluded."""
    known = players.where(~F.col("is_guest")).join(excluded.where("name is not null"), "name", "left_anti")
    return known.where("name is not null").select(F.col("id").alias("player_id"), F.col("name").alias("player"), "country", "flag")


def _each(valued: DataFrame) -> DataFrame:
    return valued.select(BOARD, "game_id", "standing", "place", "worth", "platform_id", "date", F.size("player_ids").alias("listed"), F.posexplode("player_ids").alias("position", "player_id"))


def _once(each: DataFrame) -> DataFrame:
    return first_per_key(each, [BOARD, "player_id"], [F.col("standing").asc(), F.col("position").asc()])


def _credit() -> tuple[Column, Column, Column]:
    value = round_half_away(F.col("worth") / F.col("listed"), 3).alias("value")
    return F.col("place").cast("int").alias("place"), value, F.when(F.col("date") > 0, F.timestamp_seconds("date").cast("date")).alias("date")


def numbered_boards(scored: DataFrame) -> DataFrame:
    """(board, main_game, number) of all boards with timed runs, written: numbers by the board's least game, then by name,
    so that they keep games together and a game's boards in order."""
    # distinct pairs first: they are hashed, while the least of a text is found by a sort
    games = scored.where(F.col("t").isNotNull() & F.col(BOARD).isNotNull()).select(BOARD, "game_id").distinct()
    boards = staged(games.groupBy(BOARD).agg(F.min("game_id").alias("main_game")), "boards")
    return staged(global_row_number(boards, [F.col("main_game").asc(), F.col(BOARD).asc()], "number"), "board-numbers")


def credits(valued: DataFrame, boards: DataFrame, players: DataFrame, excluded: DataFrame) -> DataFrame:
    """The same credits as `credit_runs`, with the board's number instead of its name and game; `other_game` where a run's
    game isn't the board's main game.

    Players are made single while rows still lie by board, as whether one is known depends on the player alone; then the
    rows, which are narrow by now, cross the network for their players.
    """
    each = _once(_each(valued)).join(boards, BOARD)
    each = each.select("number", F.when(F.col("game_id") != F.col("main_game"), F.col("game_id")).alias("other_game"), "player_id", "platform_id", *_credit())
    return each.join(_known(players, excluded), "player_id")


def credit_runs(valued: DataFrame, players: DataFrame, games: DataFrame, platforms: DataFrame, excluded: DataFrame, ids: bool = True) -> DataFrame:
    """The published runs: a run's value is split over its whole player list, each known player is credited once a board.

    Guests and excluded names lose their credit, not their share. With `ids`, boards are numbered by name.
    """
    each = _once(_each(valued)).join(_known(players, excluded), "player_id")  # single while rows lie by board, as in `credits`
    each = each.join(games.select(F.col("id").alias("game_id"), F.col("name").alias("game")), "game_id").join(platforms.select(F.col("id").alias("platform_id"), F.col("name").alias("platform")), "platform_id", "left")
    rows = each.select(
        F.col(BOARD).alias("leaderboard"), "game_id", "game", "player_id", "player", "country", "flag", "platform_id", "platform",
        *_credit(),
    )
    return dense_ids(rows, "leaderboard", "leaderboard_id").withColumn("leaderboard_id", F.col("leaderboard_id").cast("int")) if ids else rows
