"""Landed payloads (one JSON document a row) to raw table rows, and work lists over them.

Each payload is parsed once; what can't be read isn't lost: every result has a `quarantine` table of the payloads that gave
no rows, with the reason, the hash of the payload and all its other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coercion import as_epoch, as_int, as_seconds, stripped
from ..operators.ranking import global_row_number
from ..operators.storage import staged

Tables = dict[str, DataFrame]

_GAME = """struct<game: struct<id: string, name: string, url: string, defaultTimer: string>,
 categories: array<struct<id: string, name: string, timeDirection: string, archived: boolean>>,
 levels: array<struct<id: string, name: string>>,
 variables: array<struct<id: string, name: string, isSubcategory: boolean, archived: boolean>>,
 values: array<struct<id: string, variableId: string, name: string>>,
 platforms: array<struct<id: string, name: string, url: string>>>"""
_RUN = "struct<id: string, gameId: string, categoryId: string, levelId: string, valueIds: array<string>, playerIds: array<string>, platformId: string, time: string, timeWithLoads: string, igt: string, performedAt: string, submittedAt: string>"
_PLAYER = "struct<id: string, name: string, url: string, areaId: string, color1Id: string, color2Id: string>"
_PAGE = f"struct<leaderboard: struct<runs: array<{_RUN}>, players: array<{_PLAYER}>>, runList: array<{_RUN}>, playerList: array<{_PLAYER}>>"
_STATIC = "struct<areas: array<struct<id: string, name: string, fullName: string, lbName: string, lbFlag: string, flagIcon: struct<path: string>, parentId: string>>, colors: array<struct<id: string, name: string, darkColor: string, lightColor: string>>>"
_LIST = "struct<seriesList: array<struct<id: string, name: string, url: string>>, gameList: array<struct<id: string, name: string, url: string>>, data: array<struct<id: string, names: struct<international: string>, abbreviation: string>>>"


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def load_document(spark: SparkSession, path: str, schemas: dict[str, str], lines: bool = False) -> Tables:
    """JSON documents {table: [row, ...]}, one a file or, with `lines`, one a line: a frame for each table of `schemas`
    (name -> DDL), empty if absent."""
    whole = ", ".join(f"{name} array<struct<{ddl}>>" for name, ddl in schemas.items())
    doc = spark.read.schema(whole).json(path, multiLine=not lines)
    return {name: doc.select(F.inline(name)) for name in schemas}


_CUT = "_cut"


def _sorted_out(payloads: DataFrame, schema: str, needed: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Parsed payloads, written once: those to be read (parsed document `p`, and their columns), and the quarantine.

    Reasons: `empty`, `not JSON` (cut ones, too), `wrong type` (a field that holds something else than it should),
    `nothing needed` (what makes the payload useful is absent).
    """
    whole = f"{schema.rstrip().removesuffix('>')}, {_CUT}: string>"
    parsed = payloads.withColumn("p", F.from_json("payload", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CUT}))
    reason = (
        F.when(F.trim(F.coalesce("payload", F.lit(""))) == "", "empty")
        .when(F.try_parse_json("payload").isNull(), "not JSON")
        .when(F.col(f"p.{_CUT}").isNotNull() | F.col("p").isNull(), "wrong type")
        .when(~F.coalesce(needed, F.lit(False)), "nothing needed")
    )
    rows = staged(parsed.withColumn("reason", reason).withColumn("payload", F.when(F.col("reason").isNotNull(), F.col("payload"))), name)
    bad = rows.where("reason is not null").withColumn("payload_sha256", F.sha2("payload", 256)).drop("p")
    return rows.where("reason is null").drop("reason", "payload"), bad


def errors(quarantine: DataFrame) -> DataFrame:
    """Checkpoint rows for payloads of known games (column `game_id`) that couldn't be read: the first reason of each."""
    return quarantine.where("game_id is not null").groupBy("game_id").agg(F.lit("error").alias("status"), F.min("reason").alias("error"), F.max("seen_at").alias("finished_at"))


def parse_game_payloads(payloads: DataFrame) -> Tables:
    """`payloads`: payload, seen_at. Absent lists give no rows, absent numbers 0, absent flags false; names are stripped.
    Payloads without a game's id are in quarantine."""
    rows, bad = _sorted_out(payloads, _GAME, F.col("p.game.id").isNotNull(), "game-payloads")

    def each(field: str) -> DataFrame:
        return rows.select(F.col("p.game.id").alias("game_id"), "seen_at", F.explode(f"p.{field}").alias("x"))

    name = stripped(F.col("x.name")).alias("name")
    return {
        "raw_games": rows.select(F.col("p.game.id").alias("id"), stripped(F.col("p.game.name")).alias("name"), F.col("p.game.url").alias("url"), as_int(F.col("p.game.defaultTimer")).cast("tinyint").alias("default_timer"), "seen_at"),
        "raw_categories": each("categories").select("x.id", "game_id", name, as_int(F.col("x.timeDirection")).cast("tinyint").alias("time_direction"), _flag(F.col("x.archived")).alias("archived"), "seen_at"),
        "raw_levels": each("levels").select("x.id", "game_id", name, "seen_at"),
        "raw_variables": each("variables").select("x.id", "game_id", name, _flag(F.col("x.isSubcategory")).alias("is_subcategory"), _flag(F.col("x.archived")).alias("archived"), "seen_at"),
        "raw_values": each("values").select("x.id", F.col("x.variableId").alias("variable_id"), "game_id", name, "seen_at"),
        "raw_platforms": each("platforms").select("x.id", name, "x.url", "seen_at"),
        "quarantine": bad,
    }


def parse_page_payloads(payloads: DataFrame) -> Tables:
    """`payloads`: payload, seen_at, batch, page. Both page shapes. raw_runs keeps (batch, page, pos), see `with_ord`.
    Payloads without a list of runs are in quarantine."""
    old = F.col("p.leaderboard").isNotNull()
    runs = F.coalesce("p.leaderboard.runs", "p.runList")
    rows, bad = _sorted_out(payloads, _PAGE, runs.isNotNull(), "page-payloads")
    people = F.coalesce("p.leaderboard.players", "p.playerList")
    none = F.array().cast("array<string>")
    each = rows.select("batch", "page", F.when(old, 1).otherwise(2).cast("tinyint").alias("lb_type"), F.posexplode(runs).alias("pos", "r"))
    raw_runs = each.select(
        "batch", "page", "pos", F.col("r.id").alias("run_id"), F.col("r.gameId").alias("game_id"), F.col("r.categoryId").alias("category_id"), F.col("r.levelId").alias("level_id"),
        F.coalesce("r.valueIds", none).alias("value_ids"), F.coalesce("r.playerIds", none).alias("player_ids"), F.col("r.platformId").alias("platform_id"),
        as_seconds(F.col("r.time")).alias("time"), as_seconds(F.col("r.timeWithLoads")).alias("time_with_loads"), as_seconds(F.col("r.igt")).alias("igt"),
        as_epoch(F.col("r.performedAt")).alias("date"), as_epoch(F.col("r.submittedAt")).alias("date_submitted"), "lb_type",
    )
    players = rows.select("seen_at", F.explode(people).alias("x")).select("x.id", stripped(F.col("x.name")).alias("name"), "x.url", F.nullif(F.col("x.areaId"), F.lit("")).alias("area_id"), F.col("x.color1Id").alias("color1_id"), F.col("x.color2Id").alias("color2_id"), "seen_at")
    return {"raw_runs": raw_runs, "raw_players": players, "quarantine": bad}


def with_ord(runs: DataFrame, start: int = 0) -> DataFrame:
    """Turns (batch, page, pos) into `ord`, from `start` on: rows of earlier pages, then the place in the page."""
    rows = global_row_number(runs, [F.col(c).asc() for c in ("batch", "page", "pos")], "n")
    return rows.withColumn("ord", F.col("n") + (start - 1)).drop("n", "batch", "pos")


def next_ord(runs: DataFrame) -> DataFrame:
    """One row: the first free ord."""
    return runs.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("next_ord"))


def parse_static_payloads(payloads: DataFrame) -> Tables:
    """Areas and colours. The board name falls back to the name; a flag is its icon's path without folder and ending.
    Payloads without either list are in quarantine."""
    rows, bad = _sorted_out(payloads, _STATIC, F.coalesce("p.areas.id", "p.colors.id").isNotNull(), "static-payloads")
    path = F.coalesce("x.lbFlag", "x.flagIcon.path")
    flag = F.regexp_replace(F.regexp_replace(path, "^/images/flags/", ""), r"\.png$", "")
    areas = rows.select("seen_at", F.explode("p.areas").alias("x")).select("x.id", "x.name", F.col("x.fullName").alias("full_name"), F.coalesce(F.nullif(F.col("x.lbName"), F.lit("")), "x.name").alias("lb_name"), flag.alias("lb_flag"), F.col("x.parentId").alias("parent_id"), "seen_at")
    colors = rows.select("seen_at", F.explode("p.colors").alias("x")).select("x.id", "x.name", F.col("x.darkColor").alias("dark"), F.col("x.lightColor").alias("light"), "seen_at")
    return {"raw_areas": areas, "raw_colors": colors, "quarantine": bad}


def parse_list_payloads(payloads: DataFrame) -> Tables:
    """Series and game lists, the older shape of a game list too; `series_id` (nullable) says for which series it was.
    Payloads without any list are in quarantine."""
    rows, bad = _sorted_out(payloads, _LIST, F.coalesce("p.seriesList.id", "p.gameList.id", "p.data.id").isNotNull(), "list-payloads")
    series = rows.select("seen_at", F.explode("p.seriesList").alias("x")).select("x.id", stripped(F.col("x.name")).alias("name"), "x.url", "seen_at")
    new = rows.select("seen_at", "series_id", F.explode("p.gameList").alias("x")).select("x.id", stripped(F.col("x.name")).alias("name"), "x.url", "seen_at", "series_id")
    old = rows.select("seen_at", "series_id", F.explode("p.data").alias("x")).select("x.id", stripped(F.col("x.names.international")).alias("name"), F.col("x.abbreviation").alias("url"), "seen_at", "series_id")
    games = new.unionByName(old)
    return {"raw_series": series, "raw_game_list": games.drop("series_id"), "raw_game_series": games.where("series_id is not null").select(F.col("id").alias("game_id"), "series_id", "seen_at"), "quarantine": bad}


def pending(listed: DataFrame, checkpoint: DataFrame, excluded: list[str]) -> DataFrame:
    """Ids listed, neither done nor skipped nor excluded, sorted."""
    over = checkpoint.where(F.col("status").isin("done", "skipped")).select(F.col("game_id").alias("id"))
    left = listed.select("id").where(F.col("id").isNotNull()).distinct().join(over, "id", "left_anti")
    return (left.where(~F.col("id").isin(excluded)) if excluded else left).orderBy("id")


def without_partial(runs: DataFrame, checkpoint: DataFrame, retry_errors_only: bool = False) -> DataFrame:
    """Rows of finished games; or all but those of games that ended in an error."""
    if retry_errors_only:
        return runs.join(checkpoint.where("status = 'error'").select("game_id"), "game_id", "left_anti")
    return runs.join(checkpoint.where("status = 'done'").select("game_id"), "game_id", "left_semi")


#: Parts of a stored table of raw runs.
PARTS = 64


def _part(game: str = "game_id") -> Column:
    return F.pmod(F.xxhash64(game), F.lit(PARTS)).cast("int")


def write_raw_runs(runs: DataFrame, path: str) -> None:
    """Appends raw runs to a stored table, in parts by their game, so that a game lies in one part."""
    runs.withColumn("part", _part()).repartition("part").write.mode("append").partitionBy("part").option("compression", "zstd").parquet(path)


def drop_partial_rows(spark: SparkSession, path: str, checkpoint: DataFrame, retry_errors_only: bool = False) -> list[int]:
    """Drops the rows of unfinished games (or of those that ended in an error) from a stored table and returns the parts
    that were written anew. All other files stay as they are.

    Which parts hold such rows is read from the games' column alone. What these parts keep is written aside first, so a
    stop in between loses nothing: a part is replaced as a whole or not at all, and the next call finds what is left.
    """
    stored = spark.read.parquet(path)
    schema = stored.schema
    games = stored.select("part", "game_id").distinct()
    gone = games.join(without_partial(games, checkpoint, retry_errors_only), ["part", "game_id"], "left_anti")
    touched = [r["part"] for r in gone.select("part").distinct().collect()]  # PARTS rows at most
    if not touched:
        return []
    kept = staged(without_partial(stored.where(F.col("part").isin(touched)), checkpoint, retry_errors_only), "kept-runs")
    left = {r["part"] for r in kept.select("part").distinct().collect()}
    # a stored file has rows of one part, so tasks hold few parts each and nothing is shuffled again
    kept.select(schema.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in sorted(set(touched) - left):  # nothing is left to write there
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}"), True)
    return sorted(touched)


def included(df: DataFrame, excluded: list[str], column: str = "id") -> DataFrame:
    """Rows (categories, or runs by their category) that aren't left out at ingest; null is never left out."""
    return df.where(F.coalesce(~F.col(column).isin(excluded), F.lit(True))) if excluded else df
