"""Publishing again after a crawl that added little.

A snapshot is kept with its state: the scored input, and a digest of each row of the dimensions and of the checkpoint.
Runs that came since, and older ones whose game was not completed or not known then, are scored alone. Boards they are on
are placed anew from their rows in the old and new scored input; all others keep their rows. Points are summed anew for
players on those boards, before or after; the others keep theirs, and all are ranked again, which needs a narrow row each.

Where something else changed (a row of a dimension that was there before, a level, variable or value that came late, a
game that is no longer completed, or an older row of a run that was counted already), everything is published anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import dense_ids
from ..operators.storage import staged
from . import normalize, publish, score
from .normalize import DIMENSIONS
from .scope import INLINE
from .score import BOARD

Tables = dict[str, DataFrame]
#: Dimensions whose late rows would change what older runs are.
FIXED = ("raw_levels", "raw_variables", "raw_values", "raw_colors", "raw_areas")


def _digests(raw: Tables) -> DataFrame:
    """(name, id, digest) of the latest rows of the dimensions and the excluded players, and the status of each game."""
    parts = []
    for name in DIMENSIONS:
        columns = [c for c in sorted(raw[name].columns) if c not in ("id", "seen_at")]
        parts.append(raw[name].select(F.lit(name).alias("name"), "id", F.xxhash64(*columns).alias("digest")))
    parts.append(raw["excluded_players"].select(F.lit("excluded").alias("name"), F.col("name").alias("id"), F.lit(0).cast("long").alias("digest")))
    done = raw["crawl_checkpoint"].where("status = 'done'")
    parts.append(done.select(F.lit("done").alias("name"), F.col("game_id").alias("id"), F.lit(0).cast("long").alias("digest")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _state(raw: Tables, scored: DataFrame, digests: DataFrame) -> Tables:
    last = raw["raw_runs"].agg(F.max("ord").alias("last_ord"))
    return {"scored": scored, "digests": digests, "last": last}


def write_state(state: Tables, root: str, version: str) -> None:
    """Beside the snapshot of `version`; what lies there already stays. `scored` is clustered by board."""
    for name, df in state.items():
        path = f"{root}/version={version}/state/{name}"
        if name == "scored":
            if not _lies_in(df, path):
                _place_scored(df, path)
            continue
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _lies_in(df: DataFrame, path: str) -> bool:
    """Whether `df` reads that folder."""
    files = df.inputFiles()
    return bool(files) and all(f"{path.split(':', 1)[-1].lstrip('/')}/" in f for f in files)


def _place_scored(df: DataFrame, path: str) -> DataFrame:
    """Dealt to tasks by board and sorted by it: of each file, a few row groups hold a board. Returns the written table."""
    df.repartition(F.col(BOARD)).sortWithinPartitions(BOARD).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_state(spark: SparkSession, root: str, version: str) -> Tables:
    return {name: spark.read.parquet(f"{root}/version={version}/state/{name}") for name in ("scored", "digests", "last")}


def publish_whole(raw: Tables, data_version: str = "v1", scraped_at: str = "2024-01-08 00:00:00", at: str | None = None) -> tuple[Tables, Tables]:
    """All published tables, and the state to go on from. `at`: see publish.publish_scored; the scored input is written to
    its place there, too."""
    current = normalize.current(raw)
    place = (lambda df: _place_scored(df, f"{at}/state/scored")) if at else None
    tables, scored = publish.publish_scored(current, data_version, scraped_at, at, place)
    return tables, _state(raw, scored, staged(_digests(current), "digests"))


def _late(old: DataFrame, new: DataFrame) -> tuple[bool, dict[str, DataFrame]]:
    """Whether rows of the old digests changed or went, or rows came that don't come alone; and the ids that came, by name."""
    both = staged(old.withColumnRenamed("digest", "before").join(new, ["name", "id"], "full").where("before is null or digest is null or before <> digest"), "digest-changes")
    other = F.col("before").isNotNull() | F.col("name").isin("excluded", *FIXED)
    came = both.where(F.col("before").isNull())
    return both.where(other).limit(1).count() > 0, {name: came.where(F.col("name") == name).select("id") for name in ("raw_games", "raw_categories", "raw_players", "done")}


def _on_boards(df: DataFrame, column: str, boards: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the boards; of a few of them by their names, so that the scan skips row groups without any."""
    if len(names) <= INLINE:
        return df.where(F.col(column).isin(names))
    return df.join(boards.withColumnRenamed(BOARD, column), column, "left_semi")


def publish_again(raw: Tables, before: Tables, state: Tables, data_version: str = "v1", scraped_at: str = "2024-01-08 00:00:00") -> tuple[Tables, Tables]:
    """All published tables and the state, from those of the snapshot `before`; equal to what publish_whole makes. They must
    be written as another version, as rows of `before` are read only then."""
    current = normalize.current(raw)
    digests = staged(_digests(current), "digests")
    changed, came = _late(state["digests"], digests)
    last = state["last"].first()["last_ord"]
    if changed or last is None:
        return publish_whole(raw, data_version, scraped_at)
    rows = raw["raw_runs"]
    late = rows.where(F.col("ord") > last)
    for column, ids in (("game_id", came["raw_games"]), ("game_id", came["done"]), ("category_id", came["raw_categories"])):
        if ids.limit(1).count():
            late = late.unionByName(rows.where(F.col("ord") <= last).join(ids.withColumnRenamed("id", column), column, "left_semi").select(rows.columns))
    late = normalize.scored_input(current | {"raw_runs": late.dropDuplicates(["ord"])})
    late = staged(late, "late-scored")
    known = late.select("run_id", F.col("ord").alias("late_ord")).join(state["scored"].select("run_id", "ord"), "run_id")
    known = staged(known, "late-known")
    if known.where("late_ord < ord").limit(1).count():
        return publish_whole(raw, data_version, scraped_at)
    new = late.join(known.select("run_id").distinct(), "run_id", "left_anti")
    boards = new.select(BOARD)
    if came["raw_players"].limit(1).count():  # runs that had an unknown player
        each = state["scored"].select(BOARD, F.explode("player_ids").alias("id"))
        boards = boards.unionByName(each.join(came["raw_players"], "id", "left_semi").select(BOARD))
    boards = staged(boards.where(F.col(BOARD).isNotNull()).distinct(), "late-boards")
    players = staged(normalize.players_dim(current), "players-dim")
    names = [r[0] for r in boards.limit(INLINE + 1).collect()]
    again = staged(_on_boards(state["scored"], BOARD, boards, names).unionByName(new.where(F.col(BOARD).isNotNull())), "late-rows")
    credits = score.credit_runs(score.value_boards(again), players, normalize.latest(current, "raw_games"), normalize.latest(current, "raw_platforms"), current["excluded_players"], ids=False)
    credits = staged(credits, "late-credits")
    # names are met once, by the boards; rows are met by numbers
    numbers = staged(_on_boards(before["runs"].select("leaderboard", "leaderboard_id").distinct(), "leaderboard", boards, names), "late-numbers")
    ids = staged(numbers.select("leaderboard_id"), "late-ids")
    kept, old = before["runs"].join(ids, "leaderboard_id", "left_anti"), before["runs"].join(ids, "leaderboard_id", "left_semi")
    now = credits.select("leaderboard").distinct()
    if now.join(numbers, "leaderboard", "full").where("leaderboard_id is null").limit(1).count() or numbers.join(now, "leaderboard", "left_anti").limit(1).count():
        runs = staged(dense_ids(kept.drop("leaderboard_id").unionByName(credits), "leaderboard", "leaderboard_id").withColumn("leaderboard_id", F.col("leaderboard_id").cast("int")), "runs")
    else:  # the same boards keep their numbers, and the rows of all others stay where they are until the snapshot is written
        runs = kept.unionByName(credits.join(numbers, "leaderboard"))
    runs = runs.select(before["runs"].columns)
    touched = staged(old.select("player_id").unionByName(credits.select("player_id")).distinct(), "late-players")
    if 2 * touched.count() > before["player_ranks"].count():  # to sum all anew is less work than to find the others
        points = publish.player_points(runs)
    else:
        points = publish.player_points(runs.join(touched, "player_id", "left_semi"))
        points = before["player_ranks"].drop("rank").join(touched, "player_id", "left_anti").unionByName(points)
    tables = {"runs": runs, "player_ranks": publish.ranked(staged(points, "points")), **publish.dimensions(current, runs, players)}
    scored = state["scored"].unionByName(new)
    meta = publish.meta(tables, scored, data_version, scraped_at, raw["crawl_checkpoint"].where("status = 'error'"))
    return tables | {"meta": meta}, _state(raw, scored, digests)
