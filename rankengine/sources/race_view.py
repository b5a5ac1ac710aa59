"""The driver tables shaped as raw leaderboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import grouped_row_number
from ..operators.storage import staged

#: Fixed values of the view.
EXCLUDED_PLAYERS = ["Customer#000000001", "Customer#000000002"]
CONTINENTS = {"XA": ("Xandria", ["r0", "r1"]), "XB": ("Yonder", ["r2", "r3"])}
OLD, NEW = "2024-01-01 00:00:00", "2024-01-08 00:00:00"
FULL_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _at(text: str):
    return F.lit(text).cast("timestamp")


def _capital(c: str):
    return F.concat(F.substring(c, 1, 1), F.lower(F.substring(F.col(c), 2, 1 << 30)))


def raw_tables(spark: SparkSession, sf_dir: str, ordered: bool = True) -> dict[str, DataFrame]:
    """Name -> raw table. Without `ordered`, raw_runs has no ord; with it, raw_runs is written, as its order is much work."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n_games = max(20, read("part").count() // 20)
    runs = _runs(read("lineitem"), read("orders"), n_games, ordered)
    games = read("part").select((F.col("p_partkey") % n_games).alias("k")).distinct().select("k", F.concat(F.lit("g"), "k").alias("id"))
    return {
        "raw_runs": staged(runs, "raw-runs") if ordered else runs,
        "raw_games": _games(games),
        "raw_categories": games.crossJoin(spark.createDataFrame([("A",), ("N",), ("R",)], "flag string")).select(F.concat_ws("-", "id", "flag").alias("id"), F.col("id").alias("game_id"), F.concat(F.lit("Any "), "flag").alias("name"), F.when(F.col("flag") == "R", 1).otherwise(0).cast("tinyint").alias("time_direction"), F.lit(False).alias("archived"), _at(NEW).alias("seen_at")),
        "raw_levels": spark.createDataFrame([("LA", None, "Level A"), ("LN", None, "Level N")], "id string, game_id string, name string").withColumn("seen_at", _at(NEW)),
        "raw_variables": spark.createDataFrame([("status", None, "Status", True, False), ("number", None, "Number", False, False)], "id string, game_id string, name string, is_subcategory boolean, archived boolean").withColumn("seen_at", _at(NEW)),
        "raw_values": spark.createDataFrame([("vF", "status", None, "Final"), ("vO", "status", None, "Open"), *[(f"n{i}", "number", None, str(i)) for i in range(1, 8)]], "id string, variable_id string, game_id string, name string").withColumn("seen_at", _at(NEW)),
        "raw_series": spark.createDataFrame([(f"{c}{i}", f"Series {c.upper()}{i}", f"{c}-{i}") for c, n in (("s", 7), ("t", 4)) for i in range(n)] + [("none", "Series without games", "none")], "id string, name string, url string").withColumn("seen_at", _at(NEW)),
        "raw_game_series": _game_series(games),
        "raw_platforms": _platforms(read("orders")),
        "raw_areas": _areas(read("region"), read("nation"), read("customer")),
        "raw_colors": spark.createDataFrame([("c0", "Red", "#f00", "#a00"), ("c1", "Green", "#0f0", "#0a0"), ("c2", "Blue", "#00f", "#00a")], "id string, name string, dark string, light string").withColumn("seen_at", _at(NEW)),
        "raw_players": _players(read("customer"), read("supplier"), read("nation")),
        "crawl_checkpoint": games.select(F.col("id").alias("game_id"), F.when(F.col("k") % 17 == 0, "error").otherwise("done").alias("status"), _at(NEW).alias("finished_at")),
        "raw_game_list": games.select("id", F.concat(F.lit("Game "), "k").alias("name"), F.concat(F.lit("game"), "k").alias("url"), _at(NEW).alias("seen_at")),
        "crawl_meta": spark.createDataFrame([("version", "v1"), ("started_at", NEW.replace(" ", "T")), ("stage", "games_crawled")], "key string, value string"),
        "excluded_players": spark.createDataFrame([(x,) for x in EXCLUDED_PLAYERS], "name string"),
    }


def _runs(lineitem: DataFrame, orders: DataFrame, n_games: int, ordered: bool) -> DataFrame:
    rows = lineitem
    if ordered:
        rows = grouped_row_number(rows, FULL_ROW[0], [F.col(c).asc() for c in FULL_ROW[1:]], "_ord").withColumn("ord", F.col("_ord") - 1)
    rows = rows.join(orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    game = F.concat(F.lit("g"), F.col("l_partkey") % n_games)
    key = F.col("l_suppkey").cast("string")
    supplier = F.concat(F.lit("S"), F.when(F.col("l_suppkey") % 10 == 0, F.lpad(key, 37, "0")).otherwise(F.lpad(key, 7, "0")))
    customer = F.concat(F.lit("C"), F.col("o_custkey"))
    price = F.col("l_extendedprice")
    return rows.select(
        *(["ord"] if ordered else []),
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("run_id"),
        game.alias("game_id"),
        F.concat(game, F.lit("-"), F.col("l_returnflag")).alias("category_id"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("L"), "l_returnflag")).alias("level_id"),
        F.array(F.concat(F.lit("v"), "l_linestatus"), F.concat(F.lit("n"), "l_linenumber")).alias("value_ids"),
        F.when(F.col("l_quantity") > 40, F.array(customer, supplier)).otherwise(F.array(customer)).alias("player_ids"),
        F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).alias("platform_id"),
        F.when(F.col("l_discount") != 0, F.floor(price / 50).cast("double")).alias("time"),
        F.when(F.col("l_tax") != 0, (F.floor(price / 50) + F.col("l_linenumber")).cast("double")).alias("time_with_loads"),
        F.when(F.col("l_discount") != 0.05, F.floor(price / 60).cast("double")).alias("igt"),
        F.when(F.col("l_discount") == 0.1, F.lit(0).cast("long")).otherwise(F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))).alias("date"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("date_submitted"),
    )


def _games(games: DataFrame) -> DataFrame:
    rows = games.withColumn("age", F.explode(F.array(F.lit("old"), F.lit("new"))))
    old = F.col("age") == "old"
    return rows.select("id", F.concat(F.when(old, "Old game ").otherwise("Game "), "k").alias("name"), F.concat(F.lit("game"), "k").alias("url"), (F.col("k") % 3).cast("tinyint").alias("default_timer"), F.when(old, _at(OLD)).otherwise(_at(NEW)).alias("seen_at"))


def _platforms(orders: DataFrame) -> DataFrame:
    """The order priorities; no run is on the fifth."""
    text = F.lower(F.substring(F.col("o_orderpriority"), 3, 1 << 30))
    rows = orders.select(F.col("o_orderpriority").alias("id"), text.alias("t")).distinct()
    return rows.select("id", F.concat(F.upper(F.substring("t", 1, 1)), F.substring(F.col("t"), 2, 1 << 30)).alias("name"), F.replace("t", F.lit(" "), F.lit("-")).alias("url"), _at(NEW).alias("seen_at"))


def _game_series(games: DataFrame) -> DataFrame:
    rows = games.select("k", F.col("id").alias("game_id"), F.explode(F.array(F.concat(F.lit("s"), F.col("k") % 7), F.concat(F.lit("t"), F.col("k") % 4))).alias("series_id"))
    again = rows.where(F.col("k") % 5 == 0)
    return rows.unionByName(again).select("game_id", "series_id", _at(NEW).alias("seen_at"))


def _areas(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    regions = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), _capital("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    regions = regions.withColumns({"full_name": F.col("name"), "lb_flag": F.col("id")})
    nations = nation.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("id"), F.regexp_replace("n_name", "NATION_", "Nation ").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    nations = nations.withColumns({"full_name": F.col("name"), "lb_flag": F.col("id")})
    segments = nations.crossJoin(customer.select("c_mktsegment").distinct())
    segments = segments.select(F.concat_ws("/", "id", "c_mktsegment").alias("id"), _capital("c_mktsegment").alias("name"), F.col("id").alias("parent_id"), F.concat_ws(", ", _capital("c_mktsegment"), "name").alias("full_name"), "lb_flag")
    return regions.unionByName(nations).unionByName(segments).select("id", "name", "full_name", F.col("name").alias("lb_name"), "lb_flag", "parent_id", _at(NEW).alias("seen_at"))


def _players(customer: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    where = nation.select("n_nationkey", F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("area"))
    people = customer.join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    area = F.when(F.col("c_custkey") % 11 != 0, F.when(F.col("c_custkey") % 2 == 0, F.col("area")).otherwise(F.concat_ws("/", "area", "c_mktsegment")))
    one = people.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("key"), area.alias("area_id"))
    firms = supplier.join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("S"), F.when(F.col("s_suppkey") % 10 == 0, F.lpad(text, 37, "0")).otherwise(F.lpad(text, 7, "0")))
    two = firms.select(name.alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("area").alias("area_id"))
    rows = one.unionByName(two)
    return rows.select("id", "name", F.when(F.col("key") % 3 != 0, F.lower("id")).alias("url"), "area_id", F.concat(F.lit("c"), F.col("key") % 4).alias("color1_id"), F.concat(F.lit("c"), (F.col("key") + 1) % 4).alias("color2_id"), _at(NEW).alias("seen_at"))
