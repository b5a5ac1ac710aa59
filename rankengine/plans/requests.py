"""The request types over published tables. Each returns at most limit + 1 rows: one more than the limit tells that the
answer was cut (see `cut`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_away
from ..operators.ranking import top_n
from ..operators.storage import staged
from .publish import player_points
from .scope import Scope, apply_scope, of_players

Tables = dict[str, DataFrame]
DEFAULT_LIMIT, MAX_LIMIT = 1000, 5000
#: Sums of doubles are ordered by this many digits, so that ties don't hang on the order of addition.
STABLE = 6


def cut(df: DataFrame, limit: int) -> DataFrame:
    """The rows within the limit, with `truncated`: whether there were more (of at most limit + 1 rows)."""
    return df.withColumn("truncated", F.max("Rank").over(Window.partitionBy()) > limit).where(F.col("Rank") <= limit)


def _points(c: str = "points") -> Column:
    return round_half_away(F.round(c, STABLE) if c == "points" else F.col(c), 2).alias("Points")


def _ordered(df: DataFrame, c: str, *names: str) -> list[Column]:
    return [F.round(c, STABLE).desc(), *[F.col(n).asc() for n in names]]


def player_rankings(tables: Tables, scope: Scope, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Over everything the ranks are read, not computed; they are kept unless a location is included."""
    if scope.precomputed:
        rows = of_players(tables["player_ranks"], tables["players"], scope)
        top = rows.orderBy("rank").limit(limit + 1)
        number = F.col("rank") if scope.all_locations else F.row_number().over(Window.orderBy("rank"))
        return top.select(number.cast("long").alias("Rank"), F.col("player").alias("Player"), _points())
    points = player_points(apply_scope(tables["runs"], tables["players"], scope))
    top = top_n(points, [*_ordered(points, "points", "player"), F.col("player_id").asc()], limit + 1)
    return top.select("Rank", F.col("player").alias("Player"), _points())


def _runs_like(rows: DataFrame, order: list[Column], limit: int, scope: Scope, *more: Column) -> DataFrame:
    player = [] if scope.single_player else [F.col("player").alias("Player")]
    return top_n(rows, order, limit + 1).select("Rank", F.col("leaderboard").alias("Leaderboard"), *player, *more, _points("value"))


def runs_by_player(tables: Tables, scope: Scope, limit: int = DEFAULT_LIMIT) -> DataFrame:
    rows = apply_scope(tables["runs"], tables["players"], scope)
    return _runs_like(rows, [F.col("value").desc(), F.col("leaderboard").asc(), F.col("player").asc(), F.col("player_id").asc()], limit, scope, F.col("place").alias("Place"))


def records(tables: Tables, scope: Scope, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The most valuable run of each board."""
    rows = apply_scope(tables["runs"], tables["players"], scope)
    best = F.min_by(F.struct("leaderboard", "player", "value"), F.struct((-F.col("value")).alias("v"), "place", "player", "player_id"))
    rows = rows.groupBy("leaderboard_id").agg(best.alias("b")).select("b.*")
    return _runs_like(rows, [F.col("value").desc(), F.col("leaderboard").asc()], limit, scope)


def _grouped(rows: DataFrame, keys: list[str], label: str, limit: int) -> DataFrame:
    sums = rows.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.sum("value").alias("points"))
    return top_n(sums, _ordered(sums, "points", keys[-1]), limit + 1).select("Rank", F.col(keys[-1]).alias(label), _points())


def leaderboard_value(tables: Tables, scope: Scope, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return _grouped(apply_scope(tables["runs"], tables["players"], scope), ["leaderboard"], "Leaderboard", limit)


def game_value(tables: Tables, scope: Scope, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return _grouped(apply_scope(tables["runs"], tables["players"], scope), ["game"], "Game", limit)


def date_value(tables: Tables, scope: Scope, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return _grouped(apply_scope(tables["runs"], tables["players"], scope), ["date"], "Date", limit)


def series_value(tables: Tables, scope: Scope, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A game counts for each of its series. Runs are summed by game before they meet the bridge."""
    by_game = apply_scope(tables["runs"], tables["players"], scope).groupBy("game_id").agg(F.sum("value").alias("value"))
    rows = by_game.join(tables["game_series"], "game_id").join(tables["series"].select(F.col("id").alias("series_id"), F.col("name").alias("series")), "series_id")
    return _grouped(rows, ["series_id", "series"], "Series", limit)


REQUESTS = {"pr": player_rankings, "runs": runs_by_player, "records": records, "leaderboards": leaderboard_value, "games": game_value, "series": series_value, "dates": date_value}


def answer(tables: Tables, request_type: str, scope: Scope, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return REQUESTS[request_type](tables, scope, max(1, min(MAX_LIMIT, limit)))


#: Characters of the grams that names and what was typed are joined on, and of the beginnings of slugs and areas.
GRAM, START = 3, 8
SUGGESTED = 10


def _runs_at(text: Column, starts: Column, sizes: range) -> Column:
    """The characters of a text from each of `starts`, so many as each of `sizes`."""
    return F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(text, i, F.lit(n)) for n in sizes])))


def _grams(text: Column, least: int = 1) -> Column:
    """All runs of `least` to GRAM characters of a text."""
    return _runs_at(text, F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), range(least, GRAM + 1))


def _beginnings(text: Column, most: int, least: int = 1) -> Column:
    """The first `least` to `most` characters of a text."""
    return F.array(*[F.substring(F.coalesce(text, F.lit("")), 1, n) for n in range(least, most + 1)])


def _word_beginnings(text: Column) -> Column:
    """The first characters behind each space."""
    spaces = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)) == " ")
    return _runs_at(text, F.transform(spaces, lambda i: i + 1), range(1, START + 1))


def _typed(needles: DataFrame) -> DataFrame:
    return needles.select("needle", F.lower(F.trim("needle")).alias("q")).where("q <> ''").distinct()


def _keyed(table: DataFrame, grams: Column, only: DataFrame | None = None) -> DataFrame:
    """A row of `table` for each of its distinct `grams`, of those in `only` if that is given."""
    rows = table.withColumn("gram", F.explode(F.array_distinct(grams))).where("gram <> ''")
    return rows if only is None else rows.join(only, "gram", "left_semi")


def _closest(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n of each key; tasks keep n of each key before rows are shuffled."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n).select(key, "name", "slug", "nth")


def _name_order(q: str) -> list[Column]:
    slug = F.coalesce(F.col("slug_lower").startswith(F.col(q)), F.lit(False))
    return [F.col("name_lower").startswith(F.col(q)).desc(), slug.desc(), F.length("name").asc(), F.col("name").asc(), F.col("id").asc()]


def name_index(table: DataFrame, n: int = SUGGESTED, only: DataFrame | None = None) -> DataFrame:
    """(gram, name, slug, nth): what is suggested for each text of up to GRAM characters. So a letter that nearly all names
    hold is n rows. To be written with a snapshot; `only`: for these grams alone."""
    return _closest(_keyed(table, F.concat(_grams(F.col("name_lower")), _beginnings(F.col("slug_lower"), GRAM)), only), "gram", _name_order("gram"), n)


def _long_names(table: DataFrame, long: DataFrame, n: int) -> DataFrame:
    """Longer needles: names that hold the needle are found by the rarest of its grams, slugs by their beginnings."""
    keyed = _keyed(table, _grams(F.col("name_lower"), GRAM))
    own = long.select("needle", "q", F.explode(F.array_distinct(F.filter(_grams(F.col("q"), GRAM), lambda g: F.length(g) == GRAM))).alias("gram"))
    counts = keyed.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("needle", "q").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    rarest = staged(rarest, "rarest-grams")  # written: of unknown size it would make Spark broadcast the names by gram, taken for a small file
    held = keyed.join(rarest, "gram").where(F.col("name_lower").contains(F.col("q")))
    starts = long.withColumn("gram", F.substring("q", 1, START))
    begun = _keyed(table, _beginnings(F.col("slug_lower"), START, GRAM + 1)).join(starts, "gram").where(F.col("slug_lower").startswith(F.col("q")))
    return _closest(held.unionByName(begun).drop("gram").dropDuplicates(["needle", "id"]), "needle", _name_order("q"), n)


def suggest_names(table: DataFrame, needles: DataFrame, n: int = SUGGESTED, index: DataFrame | None = None) -> DataFrame:
    """(needle, name, slug, nth): names that hold the needle or slugs that begin with it, the closest first. A needle is
    taken literally. `index`: a written name_index of the table."""
    typed = staged(_typed(needles), "typed")
    short = typed.where(F.length("q") <= GRAM).withColumnRenamed("q", "gram")
    index = name_index(table, n, short.select("gram").distinct()) if index is None else index
    known = short.join(index, "gram").where(F.col("nth") <= n).select("needle", "name", "slug", "nth")
    return known.unionByName(_long_names(table, typed.where(F.length("q") > GRAM), n))


def _area_starts(areas: DataFrame) -> Column:
    name = F.col("name_lower")
    return F.concat(_beginnings(name, START), _beginnings(F.lower("full_name"), START), _beginnings(F.col("id_lower"), START), _word_beginnings(name))


def _closest_areas(rows: DataFrame, lands: DataFrame, key: str, q: str, n: int) -> DataFrame:
    """Rows that an area's name, a word of it, its full name or its whole id match."""
    name, full, q = F.col("name_lower"), F.coalesce(F.lower("full_name"), F.lit("")), F.col(q)
    found = rows.where(name.startswith(q) | full.startswith(q) | name.contains(F.concat(F.lit(" "), q)) | (F.col("id_lower") == q))
    found = found.join(lands.select(F.lower("code").alias("id_lower"), F.lit(True).alias("clash")), "id_lower", "left")
    shown = found.select(
        key, F.coalesce("full_name", "name").alias("name"), F.when(F.col("clash").isNull(), F.col("id")).alias("slug"),
        F.when(name.startswith(q), 1).otherwise(2).alias("o1"), (F.size(F.split("id", "/")) - 1).alias("o2"), F.length("name").alias("o3"), F.col("name").alias("o4"), F.col("id").alias("o5"),
    )
    order = [F.col(f"o{i}").asc() for i in range(1, 6)]
    return shown.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n)


def area_index(areas: DataFrame, continents: DataFrame, n: int = SUGGESTED, only: DataFrame | None = None) -> DataFrame:
    """What areas are suggested for each text shorter than START characters, with their order; see name_index."""
    lands = continents.select("code", "continent").distinct()
    return _closest_areas(_keyed(areas, _area_starts(areas), only).where(F.length("gram") < START), lands, "gram", "gram", n).drop("nth")


def suggest_locations(areas: DataFrame, continents: DataFrame, needles: DataFrame, n: int = SUGGESTED, index: DataFrame | None = None) -> DataFrame:
    """(needle, name, slug, nth): continents first, then areas from the top of the hierarchy down. An area whose id is a
    continent's code is offered without its id. `index`: a written area_index of the areas."""
    lands, typed = continents.select("code", "continent").distinct(), _typed(needles)
    keys = _keyed(lands, F.concat(_grams(F.lower("continent")), _beginnings(F.lower("code"), GRAM)))
    one = keys.join(typed.withColumn("gram", F.substring("q", 1, GRAM)), "gram")
    one = one.where(F.lower("continent").contains(F.col("q")) | (F.lower("code") == F.col("q")))
    zero = F.lit(0)
    one = one.select("needle", F.col("continent").alias("name"), F.col("code").alias("slug"), zero.alias("o1"), zero.alias("o2"), zero.alias("o3"), F.col("code").alias("o4"), F.col("code").alias("o5"))
    short = typed.where(F.length("q") < START).withColumnRenamed("q", "gram")
    index = area_index(areas, continents, n, short.select("gram").distinct()) if index is None else index
    two = short.join(index, "gram").drop("gram")
    long = _keyed(areas, _area_starts(areas)).join(typed.where(F.length("q") >= START).withColumn("gram", F.substring("q", 1, START)), "gram")
    three = _closest_areas(long, lands, "needle", "q", n).drop("nth")
    order = [F.col(f"o{i}").asc() for i in range(1, 6)]
    return _closest(one.unionByName(two).unionByName(three), "needle", order, n)


def player_styles(names: DataFrame, players: DataFrame, areas: DataFrame) -> DataFrame:
    """Flag, its name and colours for result names (column `name`) of players that have a flag or a colour."""
    dressed = players.where("flag is not null or color1 is not null").join(names.select("name").distinct(), "name", "left_semi")
    flags = areas.select(F.col("id").alias("flag"), F.col("lb_name").alias("flag_name"))
    return dressed.join(flags, "flag", "left").select("name", "flag", "flag_name", "color1", "color2").distinct()


def cell_slugs(names: DataFrame, table: DataFrame) -> DataFrame:
    """(name, slug) for result names whose slug differs from the name."""
    return table.where("slug is not null and slug <> name").join(names.select("name").distinct(), "name", "left_semi").select("name", "slug").distinct()


def freshness(meta: DataFrame, now: Column | None = None, days: int = 9) -> DataFrame:
    """The meta row with `stale`: scraped more than `days` days ago."""
    now = F.current_timestamp() if now is None else now
    return meta.withColumn("stale", F.unix_timestamp(now) - F.unix_timestamp("scraped_at") > days * 86400)
