"""The registered leaderboard queries over the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_away
from ..operators import ranking, storage
from ..sources import payloads, race_view
from ..streaming import ingest
from . import answers, batch, increment, normalize, publish, quality, requests, resolve, score
from .oracles import normal, published, round_, scored, sql
from .scope import Scope

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(statement: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = statement
        return f

    return add


_READ = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_WRITTEN: dict[tuple[str, str, str], tuple[str, dict[str, DataFrame]]] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files under the input tables."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for name in _READ:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(conf)
        listed = files.listStatus(path) if files.exists(path) else []
        out += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in listed]
    return "; ".join(out)


def _written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables that queries share: written to shared storage, made anew when the input files change. Nothing is held in
    memory."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _state(spark, sf_dir)
    if key not in _WRITTEN or _WRITTEN[key][0] != state:
        _WRITTEN[key] = state, make()
    return _WRITTEN[key][1]


def _raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _written(spark, sf_dir, "raw", lambda: race_view.raw_tables(spark, sf_dir))


def _current(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw tables with the latest rows of dimensions."""
    return _written(spark, sf_dir, "current", lambda: normalize.current(_raw(spark, sf_dir)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What boards are placed from."""
    return _written(spark, sf_dir, "scored", lambda: {"rows": storage.staged(normalize.scored_input(_current(spark, sf_dir)), "scored")})["rows"]


def _snapshot(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    root = _shared(spark, "snapshot")
    tables = publish.publish_crawl(_current(spark, sf_dir), f"{root}/version=2024-01-08")
    publish.write_snapshot(tables, root, "2024-01-08", placed=("runs",))
    return publish.read_snapshot(spark, root)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The published tables, read from a written snapshot."""
    return _written(spark, sf_dir, "published", lambda: _snapshot(spark, sf_dir))


def fresh_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The published tables, made anew from the input."""
    for name in ("raw", "current", "scored", "published"):
        _WRITTEN.pop((spark.sparkContext.applicationId, sf_dir, name), None)
    return _tables(spark, sf_dir)


def _shared(spark: SparkSession, name: str) -> str:
    return storage.new_path(spark, name)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: round_half_away(F.col(c), n) for c, n in digits.items()})


def _lands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, a) for c, (n, ids) in race_view.CONTINENTS.items() for a in ids], "code string, continent string, area_id string")


# -- normalisation ---------------------------------------------------------------------------------------------------


@_query(normal("SELECT id, name, url, default_timer::INTEGER AS default_timer FROM games_now"))
def latest_per_id(spark, sf_dir):
    return ranking.latest_per_key(_raw(spark, sf_dir)["raw_games"], "id").select("id", "name", "url", F.col("default_timer").cast("int").alias("default_timer"))


@_query(normal("SELECT run_id, ord, game_id FROM runs_now"))
def first_per_run(spark, sf_dir):
    return normalize.completed_runs(_raw(spark, sf_dir)).select("run_id", "ord", "game_id")


@_query(normal("SELECT run_id, subcat_text FROM sub_text"))
def subcat_text(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return normalize.subcategory_text(normalize.completed_runs(raw), normalize.subcategory_values(raw))


@_query(normal("SELECT ord, run_id, game_id, platform_id, array_to_string(player_ids, '|') AS player_ids, leaderboard_name, is_reverse, t, missing_primary, date, date_submitted, is_level_run FROM scored_input"))
def scored_input(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("player_ids", F.array_join("player_ids", "|"))


@_query(normal("SELECT * FROM players_now"))
def players_dim(spark, sf_dir):
    return normalize.players_dim(_raw(spark, sf_dir))


# -- scoring ---------------------------------------------------------------------------------------------------------


@_query(scored("SELECT run_id, leaderboard_name, ranked_time, standing, place, entries FROM placed"))
def board_places(spark, sf_dir):
    return score.board_places(_scored(spark, sf_dir)).select("run_id", "leaderboard_name", "ranked_time", F.col("standing").cast("long").alias("standing"), F.col("place").cast("long").alias("place"), "entries")


@_query(scored("SELECT leaderboard_name, found AS record_count FROM improved"))
def record_walk(spark, sf_dir):
    return score.record_counts(_scored(spark, sf_dir))


@_query(scored(f"SELECT leaderboard_name, total::BIGINT AS timed_runs_seen, n::BIGINT AS entries, records::BIGINT AS record_count, {round_('minutes', 3)} AS minutes, {round_('length_factor', 6)} AS length_factor, {round_('top_worth', 3)} AS top_worth, {round_("shape", 6)} AS shape FROM board"))
def board_stats(spark, sf_dir):
    return _rounded(score.board_stats(score.board_places(_scored(spark, sf_dir))), minutes=3, length_factor=6, top_worth=3, shape=6)


@_query(scored(f"SELECT run_id, leaderboard_name, place, {round_('worth', 3)} AS worth FROM valued"))
def run_values(spark, sf_dir):
    rows = score.value_boards(_scored(spark, sf_dir)).select("run_id", "leaderboard_name", F.col("place").cast("long").alias("place"), "worth")
    return _rounded(rows, worth=3)


@_query(published("SELECT * FROM runs"))
def runs_published(spark, sf_dir):
    return publish.published_runs(_current(spark, sf_dir), _scored(spark, sf_dir))


@_query(published(f"SELECT rank, player_id, player, country, flag, {round_('points', 3)} AS points FROM player_ranks"))
def player_ranks(spark, sf_dir):
    return _rounded(_tables(spark, sf_dir)["player_ranks"], points=3)


# -- requests --------------------------------------------------------------------------------------------------------

#: Points of a player: values from the greatest down, each worth a hundredth less, a quarter at least.
_POINTS = "list_sum(list_transform(list_reverse_sort(list(value)), lambda v, i: greatest(v * power(0.99::DOUBLE, i - 1), v / 4)))"


def _numbered(rows: str, order: str, columns: str, limit: int) -> str:
    """The first limit + 1 of `rows` in `order`, numbered."""
    return published(f'SELECT row_number() OVER (ORDER BY {order}) AS "Rank", {columns} FROM ({rows}) ORDER BY {order} LIMIT {limit + 1}')


def _scoped_pr(where: str, limit: int) -> str:
    rows = f"SELECT player_id, max(player) AS player, round({_POINTS}, 6) AS points FROM runs WHERE {where} GROUP BY player_id"
    return _numbered(rows, "points DESC, player, player_id", f'player AS "Player", {round_("points")} AS "Points"', limit)


_EUROPE = ("r1", "r1/n1", "r1/n6", "r1/n11", "r1/n16", "r1/n21")


@_query(published(f'SELECT rank::BIGINT AS "Rank", player AS "Player", {round_("round(points, 6)")} AS "Points" FROM player_ranks ORDER BY 1 LIMIT 1001'))
def req_pr_all(spark, sf_dir):
    return requests.player_rankings(_tables(spark, sf_dir), Scope())


@_query(published(f"""SELECT row_number() OVER (ORDER BY rank) AS "Rank", player AS "Player", {round_("round(points, 6)")} AS "Points" FROM player_ranks
    WHERE player_id IN (SELECT id FROM players WHERE area_id IN {_EUROPE}) ORDER BY 1 LIMIT 101"""))
def req_pr_location(spark, sf_dir):
    return requests.player_rankings(_tables(spark, sf_dir), Scope(inc_areas=_EUROPE, all_locations=False), 100)


@_query(_scoped_pr("game_id IN ('g1', 'g2', 'g5') OR platform_id = '2-HIGH'", 1000))
def req_pr_scoped(spark, sf_dir):
    return requests.player_rankings(_tables(spark, sf_dir), Scope(inc_games=("g1", "g2", "g5"), inc_platforms=("2-HIGH",), all_scope=False))


@_query(_scoped_pr("substr(player_id, 1, 1) = 'C' AND substr(player_id, 2)::INTEGER BETWEEN 1 AND 700", 1000))
def req_pr_many_players(spark, sf_dir):
    """More ids than become literals in the plan, and all games as a table."""
    t = _tables(spark, sf_dir)
    return requests.player_rankings(t, Scope(inc_players=tuple(f"C{i}" for i in range(1, 701)), all_players=False, all_scope=False, inc_games=t["games"].select("id")))


_RUN_ORDER = "value DESC, leaderboard, player, player_id"


@_query(_numbered("SELECT * FROM runs WHERE game_id IN ('g1', 'g3')", _RUN_ORDER, f'leaderboard AS "Leaderboard", player AS "Player", place AS "Place", {round_("value")} AS "Points"', 500))
def req_runs(spark, sf_dir):
    return requests.runs_by_player(_tables(spark, sf_dir), Scope(inc_games=("g1", "g3"), all_scope=False), 500)


@_query(_numbered("SELECT * FROM runs WHERE player_id = 'C10'", _RUN_ORDER, f'leaderboard AS "Leaderboard", place AS "Place", {round_("value")} AS "Points"', 1000))
def req_runs_single(spark, sf_dir):
    return requests.runs_by_player(_tables(spark, sf_dir), Scope(inc_players=("C10",), all_players=False, single_player=True))


_BEST = "SELECT x.* FROM (SELECT arg_min({'leaderboard': leaderboard, 'player': player, 'value': value}, (-value, place, player, player_id)) AS x FROM runs GROUP BY leaderboard_id)"


@_query(_numbered(_BEST, "value DESC, leaderboard", f'leaderboard AS "Leaderboard", player AS "Player", {round_("value")} AS "Points"', 300))
def req_records(spark, sf_dir):
    return requests.records(_tables(spark, sf_dir), Scope(), 300)


def _grouped_sql(column: str, label: str, limit: int) -> str:
    rows = f"SELECT {column} AS k, round(sum(value), 6) AS points FROM runs GROUP BY {column} HAVING k IS NOT NULL"
    return _numbered(rows, "points DESC, k", f'k AS "{label}", {round_("points")} AS "Points"', limit)


@_query(_grouped_sql("leaderboard", "Leaderboard", 200))
def req_leaderboards(spark, sf_dir):
    return requests.leaderboard_value(_tables(spark, sf_dir), Scope(), 200)


@_query(_grouped_sql("game", "Game", 1000))
def req_games(spark, sf_dir):
    return requests.game_value(_tables(spark, sf_dir), Scope())


@_query(_grouped_sql("date", "Date", 1000))
def req_dates(spark, sf_dir):
    return requests.date_value(_tables(spark, sf_dir), Scope())


_BY_SERIES = "SELECT first(s.name) AS k, round(sum(g.value), 6) AS points FROM series s, game_series b, (SELECT game_id, sum(value) AS value FROM runs GROUP BY game_id) g WHERE s.id = b.series_id AND b.game_id = g.game_id GROUP BY s.id"


@_query(_numbered(_BY_SERIES, "points DESC, k", f'k AS "Series", {round_("points")} AS "Points"', 1000))
def req_series(spark, sf_dir):
    return requests.series_value(_tables(spark, sf_dir), Scope())


@_query(published("""SELECT leaderboard, player_id, platform_id, value FROM runs
    WHERE game_id NOT IN ('g1', 'g4') AND (platform_id IS NULL OR platform_id <> '1-URGENT') AND player_id NOT IN ('C10', 'C20')
      AND player_id NOT IN (SELECT id FROM players WHERE area_id IN ('r0/n0', 'r2/n2'))"""))
def scope_exclusions(spark, sf_dir):
    t = _tables(spark, sf_dir)
    chosen = Scope(exc_games=("g1", "g4"), exc_platforms=("1-URGENT",), exc_players=("C10", "C20"), exc_areas=("r0/n0", "r2/n2"))
    return requests.apply_scope(t["runs"], t["players"], chosen).select("leaderboard", "player_id", "platform_id", "value")


# -- dimensions and meta ---------------------------------------------------------------------------------------------


@_query(published("SELECT id, name, slug, name_lower, slug_lower, default_timer::INTEGER AS default_timer FROM games"))
def dims_games(spark, sf_dir):
    return _tables(spark, sf_dir)["games"].withColumn("default_timer", F.col("default_timer").cast("int"))


@_query(published("SELECT * FROM series"))
def dims_series(spark, sf_dir):
    return _tables(spark, sf_dir)["series"]


@_query(published("SELECT * FROM areas"))
def dims_areas(spark, sf_dir):
    return _tables(spark, sf_dir)["areas"]


@_query(published("SELECT * FROM platforms"))
def dims_platforms(spark, sf_dir):
    return _tables(spark, sf_dir)["platforms"]


@_query(published("SELECT * FROM players"))
def dims_players(spark, sf_dir):
    return _tables(spark, sf_dir)["players"]


@_query(published("SELECT * FROM game_series"))
def bridge(spark, sf_dir):
    return _tables(spark, sf_dir)["game_series"]


_META = """SELECT 1 AS schema_version, 'v1' AS data_version, '2024-01-08'::TIMESTAMP AS scraped_at, (SELECT count(*) FROM runs) AS row_count, (SELECT count(*) FROM scored_input) AS raw_run_count,
    (SELECT count(*) FROM games) AS game_count, (SELECT count(DISTINCT leaderboard_id) FROM runs) AS leaderboard_count, (SELECT count(*) FROM players) AS player_count,
    (SELECT count(*) FROM checkpoint WHERE status = 'error')::INTEGER AS errored_games"""


@_query(published(_META))
def meta(spark, sf_dir):
    return _tables(spark, sf_dir)["meta"].drop("published_at").withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))


@_query(published(f"SELECT data_version, row_count, '2024-01-20'::TIMESTAMP - scraped_at > INTERVAL 9 DAY AS stale FROM ({_META})"))
def freshness(spark, sf_dir):
    rows = requests.freshness(_tables(spark, sf_dir)["meta"], F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return rows.select("data_version", "row_count", "stale")


# -- request log -----------------------------------------------------------------------------------------------------

#: A request for each customer, made from its row, beside fixed ones that hold the odd cases.
_FIXED = ["g=game1,!game2,game1&r=runs", "games=Game+4%2C++game+5+&request-type=records", "u=Customer%23000000010&l=XA,!r0/n0", "s=s-1,+t-2+,none&m=99999", "l=Yonder,nation+3,r4/n4&r=bogus", "g=&p=!&m=abc", "p=High,!urgent&g=a,,b,&limit=10", "countries=us&r=", "s=nothing&g=Game+3,game+3", "l=Building,r1&u=!Supplier%23000000001,c4"]
_FIXED_SQL = f"""SELECT 'f' || (i - 1) AS request_id, q AS query FROM (SELECT unnest(range(1, {len(_FIXED) + 1})) AS i, unnest([{", ".join(f"'{q}'" for q in _FIXED)}]) AS q)"""
_PARSED = f"""pairs AS (SELECT request_id, i AS pos, split_part(x, '=', 1) AS k, CASE WHEN contains(x, '=') THEN url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' ')) ELSE '' END AS value
    FROM (SELECT request_id, unnest(string_split(query, '&')) AS x, generate_subscripts(string_split(query, '&'), 1) AS i FROM log)),
keys AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}'), ('{v}', '{v}')" for k, v in resolve.KEYS.items())}) x(k, key)),
params AS (SELECT request_id, pos, key, value FROM pairs JOIN (SELECT DISTINCT * FROM keys) USING (k)),
pieces AS (SELECT request_id, key AS box, pos, unnest(string_split(value, ',')) AS raw, generate_subscripts(string_split(value, ','), 1) AS nth FROM params WHERE key NOT IN ('request-type', 'limit')),
signs AS (SELECT request_id, box, pos, nth, if(trim(raw)[1] = '!', '!', '') AS sign, if(trim(raw)[1] = '!', trim(trim(raw)[2:]), trim(raw)) AS term FROM pieces),
first_terms AS (SELECT * FROM signs WHERE term <> '' QUALIFY row_number() OVER (PARTITION BY request_id, box, sign, lower(term) ORDER BY pos, nth) = 1),
terms AS (SELECT request_id, box, sign, term, row_number() OVER (PARTITION BY request_id, box ORDER BY pos, nth) AS pos FROM first_terms),
lasts AS (SELECT request_id, trim(coalesce(arg_max(value, pos) FILTER (key = 'request-type'), '')) AS type, trim(coalesce(arg_max(value, pos) FILTER (key = 'limit'), '')) AS lim FROM params GROUP BY request_id),
settings AS (
    SELECT l.request_id, if(type IN {resolve.TYPES}, type, 'pr') AS request_type,
           CASE WHEN regexp_full_match(lim, '[+-]?[0-9]+') THEN greatest(1, least(5000, lim::BIGINT)) ELSE 1000 END::INTEGER AS "limit",
           (type <> '' AND type NOT IN {resolve.TYPES})::INTEGER + (lim <> '' AND NOT regexp_full_match(lim, '[+-]?[0-9]+'))::INTEGER AS n_warnings
    FROM (SELECT log.request_id, coalesce(type, '') AS type, coalesce(lim, '') AS lim FROM log LEFT JOIN lasts USING (request_id)) l),
area_keys AS (SELECT DISTINCT unnest([id_lower, name_lower, lower(full_name)]) AS key, id, coalesce(full_name, name) AS name, id AS slug FROM areas),
box_keys AS (SELECT 'locations' AS box, * FROM area_keys
    {" ".join(f"UNION ALL SELECT DISTINCT '{b}', unnest([name_lower, slug_lower]), id, name, slug FROM {b}" for b in ("games", "series", "platforms", "players"))}),
land_keys AS (SELECT lower(code) AS key, code, continent, area_id FROM lands UNION ALL SELECT lower(continent), code, continent, area_id FROM lands),
matches AS (
    SELECT request_id, t.box, sign, term, pos, b.id, b.name, b.slug, false AS land FROM terms t LEFT JOIN box_keys b ON b.box = t.box AND b.key = lower(term)
    WHERE NOT (t.box = 'locations' AND lower(term) IN (SELECT key FROM land_keys))
    UNION ALL SELECT request_id, t.box, sign, term, pos, area_id, continent, code, true FROM terms t JOIN land_keys ON key = lower(term) AND t.box = 'locations'),
roots AS (SELECT DISTINCT request_id, sign, id FROM matches WHERE box = 'locations' AND id IS NOT NULL)"""
_LOG_SQL = f"""log AS (
    {_FIXED_SQL}
    UNION ALL SELECT 'c' || c_custkey, concat('g=game', c_custkey % 30, ',!Game+', c_custkey % 7, '&u=C', c_custkey, '&l=Nation+', c_nationkey, '&r=', [ 'pr', 'runs', 'dates', 'none' ][(c_custkey % 4 + 1)::INTEGER], '&m=', c_custkey) FROM customer),
{_PARSED}"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([(f"f{i}", q) for i, q in enumerate(_FIXED)], "request_id string, query string")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("pr", "runs", "dates", "none"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    query = F.concat(F.lit("g=game"), F.col("c_custkey") % 30, F.lit(",!Game+"), F.col("c_custkey") % 7, F.lit("&u=C"), "c_custkey", F.lit("&l=Nation+"), "c_nationkey", F.lit("&r="), kind, F.lit("&m="), "c_custkey")
    return fixed.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("request_id"), query.alias("query")))


@_query(published("SELECT request_id, box, sign, term, pos::INTEGER AS pos FROM terms", _LOG_SQL))
def request_log(spark, sf_dir):
    return resolve.request_terms(_log(spark, sf_dir))


@_query(published("""SELECT s.*, coalesce(a = 0, true) AS all_scope, coalesce(u = 0, true) AS all_players, coalesce(l = 0, true) AS all_locations, coalesce(u = 1, false) AS single_player FROM settings s LEFT JOIN
    (SELECT request_id, count(*) FILTER (sign = '' AND box IN ('series', 'games', 'platforms')) AS a, count(*) FILTER (sign = '' AND box = 'players') AS u, count(*) FILTER (sign = '' AND box = 'locations') AS l FROM terms GROUP BY 1) t USING (request_id)""", _LOG_SQL))
def request_flags(spark, sf_dir):
    log = _log(spark, sf_dir)
    settings = resolve.request_settings(log).withColumn("n_warnings", F.size("warnings")).drop("warnings")
    return settings.join(resolve.request_flags(log, resolve.request_terms(log)), "request_id")


@_query(published("""SELECT s.request_id, concat_ws('&', t.boxes, 'r=' || request_type, CASE WHEN "limit" <> 1000 THEN 'm=' || "limit" END) AS canonical FROM settings s LEFT JOIN
    (SELECT request_id, string_agg(part, '&' ORDER BY nth) AS boxes FROM
        (SELECT request_id, list_position(['series', 'games', 'platforms', 'players', 'locations'], box) AS nth, ['s', 'g', 'p', 'u', 'l'][list_position(['series', 'games', 'platforms', 'players', 'locations'], box)] || '=' || string_agg(sign || term, ',' ORDER BY pos) AS part FROM terms GROUP BY request_id, box)
     GROUP BY 1) t USING (request_id)""", _LOG_SQL))
def request_canonical(spark, sf_dir):
    return resolve.canonical(_log(spark, sf_dir))


@_query(published("""SELECT request_id, box, sign, term, count(id) AS matches, arg_min(name, id) AS name, CASE WHEN bool_or(land) OR count(id) = 1 THEN arg_min(slug, id) END AS slug,
    CASE WHEN count(id) = 0 THEN concat('Nothing found in ', box, ': ', term) END AS warning FROM matches GROUP BY request_id, box, sign, term, pos""", _LOG_SQL))
def term_lookup(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return resolve.term_summary(resolve.matched_terms(resolve.request_terms(_log(spark, sf_dir)), t, _lands(spark))).drop("pos")


@_query(published("SELECT DISTINCT request_id, sign, id FROM (SELECT * FROM roots UNION ALL SELECT request_id, sign, a.id FROM roots r JOIN areas a ON starts_with(a.id, r.id || '/'))", _LOG_SQL))
def location_closure(spark, sf_dir):
    """All areas are published, so no snapshot is made for them."""
    areas = publish.areas(race_view.raw_tables(spark, sf_dir, ordered=False))
    return resolve.location_ids(resolve.request_terms(_log(spark, sf_dir)), areas, _lands(spark))


@_query(published("""SELECT DISTINCT request_id, sign, id FROM (SELECT request_id, sign, id FROM matches WHERE box = 'games' AND id IS NOT NULL
    UNION ALL SELECT request_id, sign, game_id FROM matches m JOIN game_series b ON m.box = 'series' AND b.series_id = m.id)""", _LOG_SQL))
def series_games(spark, sf_dir):
    t = _tables(spark, sf_dir)
    matches = resolve.matched_terms(resolve.request_terms(_log(spark, sf_dir)), t, _lands(spark))
    return resolve.resolved_ids(matches, t).where("kind = 'games'").drop("kind")


#: Queries of nine kinds, with customers' numbers in place of k, n and x: scopes that are shared, that are someone's own, and none.
_KINDS = [
    ("'g=game', k % 30, ',game', k % 23, '&r=games&m=', k % 9"), ("'l=Nation+', n, '&r=pr&m=20'"), ("'u=C', k, ',!C', k + 1, '&r=runs'"), ("'s=t-', k % 4, '&p=high&l=!r', n % 5, '&r=leaderboards&m=15'"),
    ("'p=urgent,low&g=!game', k % 13, '&r=dates&m=10'"), ("'g=game', k % 30, '&u=!C', k, '&r=records&m=25'"), ("'l=', x, ',none&g=game', k % 30, '&r=series'"), ("'u=Customer%23', x, ',C', k, '&r=pr'"), ("'g=!game', k % 7, '&r=', if(k % 2 = 0, 'pr', 'runs'), '&m=', k % 50"),
]
_MIXED = f"""{_FIXED_SQL} UNION ALL SELECT 'c' || k, CASE {" ".join(f"WHEN k % 9 = {i} THEN concat({q})" for i, q in enumerate(_KINDS))} END
    FROM (SELECT c_custkey AS k, c_nationkey AS n, lower(c_mktsegment) AS x FROM customer)"""
_ANSWERS = f"""log AS ({_MIXED}),
{_PARSED},
wanted AS (
    SELECT request_id, 'g' AS kind, sign, id FROM matches WHERE box = 'games' UNION SELECT request_id, 'g', sign, game_id FROM matches m JOIN game_series b ON box = 'series' AND series_id = m.id
    UNION SELECT request_id, if(box = 'players', 'u', 'p'), sign, id FROM matches WHERE box IN ('platforms', 'players')
    UNION SELECT request_id, 'l', sign, id FROM roots UNION SELECT request_id, 'l', sign, a.id FROM roots r JOIN areas a ON starts_with(a.id, r.id || '/')),
asked AS (
    SELECT s.request_id, request_type, "limit", n_warnings, coalesce(scope_given, false) AS scope_given, coalesce(player_given, 0) AS player_given, coalesce(place_given, false) AS place_given, {", ".join(f"coalesce({k}{i}, []) AS {k}{i}" for k in "gpul" for i in (1, 0))}
    FROM settings s
    LEFT JOIN (SELECT request_id, bool_or(sign = '' AND box IN ('series', 'games', 'platforms')) AS scope_given, count(*) FILTER (sign = '' AND box = 'players') AS player_given, bool_or(sign = '' AND box = 'locations') AS place_given FROM terms GROUP BY 1) t USING (request_id)
    LEFT JOIN (SELECT request_id, {", ".join(f"list(id) FILTER (kind = '{k}' AND sign = '{s}') AS {k}{i}" for k in "gpul" for i, s in ((1, ""), (0, "!")))} FROM wanted WHERE id IS NOT NULL GROUP BY 1) w USING (request_id)),
allowed AS MATERIALIZED (SELECT request_id, p.id AS player_id FROM asked, players p WHERE (player_given = 0 OR p.id IN u1) AND p.id NOT IN u0 AND (NOT place_given OR coalesce(area_id IN l1, false)) AND NOT coalesce(area_id IN l0, false)),
spots AS MATERIALIZED (SELECT request_id, game_id, platform_id FROM asked, (SELECT DISTINCT game_id, platform_id FROM runs) WHERE (NOT scope_given OR game_id IN g1 OR coalesce(platform_id IN p1, false)) AND game_id NOT IN g0 AND NOT coalesce(platform_id IN p0, false)),
ready AS (SELECT request_id FROM asked WHERE request_type = 'pr' AND NOT scope_given AND len(g0) + len(p0) = 0),
narrow AS (SELECT request_id, request_type FROM asked WHERE (player_given > 0 OR place_given) AND request_id NOT IN (SELECT request_id FROM ready)),
wide AS (SELECT request_id, request_type, u0, l0 FROM asked WHERE player_given = 0 AND NOT place_given AND request_id NOT IN (SELECT request_id FROM ready)),
seen AS MATERIALIZED (
    SELECT request_id, request_type, leaderboard_id, leaderboard, r.game_id, game, date, player_id, player, place, value FROM narrow JOIN allowed USING (request_id) JOIN runs r USING (player_id) SEMI JOIN spots s ON s.request_id = narrow.request_id AND s.game_id = r.game_id AND s.platform_id IS NOT DISTINCT FROM r.platform_id
    UNION ALL SELECT request_id, request_type, leaderboard_id, leaderboard, r.game_id, game, date, player_id, player, place, value FROM wide JOIN spots s USING (request_id) JOIN runs r ON s.game_id = r.game_id AND s.platform_id IS NOT DISTINCT FROM r.platform_id JOIN players p ON p.id = r.player_id
    WHERE r.player_id NOT IN u0 AND NOT coalesce(p.area_id IN l0, false)),
ranked AS (
    SELECT request_id, round({_POINTS}, 6) AS v, max(player) AS a, player_id AS b, NULL::VARCHAR AS c, NULL::VARCHAR AS player, NULL::INTEGER AS place, NULL::BIGINT AS given FROM seen WHERE request_type = 'pr' GROUP BY request_id, player_id
    UNION ALL SELECT request_id, value, leaderboard, player, player_id, player, place, NULL FROM seen WHERE request_type = 'runs'
    UNION ALL SELECT request_id, value, leaderboard, NULL, NULL, player, NULL, NULL FROM seen WHERE request_type = 'records' QUALIFY row_number() OVER (PARTITION BY request_id, leaderboard_id ORDER BY value DESC, place, player, player_id) = 1
    {" ".join(f"UNION ALL SELECT request_id, round(sum(value), 6), {k}::VARCHAR, NULL, NULL, NULL, NULL, NULL FROM seen WHERE request_type = '{t}' AND {k} IS NOT NULL GROUP BY request_id, {k}" for t, k in (("leaderboards", "leaderboard"), ("games", "game"), ("dates", "date")))}
    UNION ALL SELECT request_id, round(sum(value), 6), s.name, s.id, NULL, NULL, NULL, NULL FROM (SELECT request_id, game_id, sum(value) AS value FROM seen WHERE request_type = 'series' GROUP BY ALL) x JOIN game_series USING (game_id) JOIN series s ON s.id = series_id GROUP BY request_id, s.name, s.id
    UNION ALL SELECT request_id, round(points, 6), player, player_id, NULL, NULL, NULL, if(place_given, NULL, rank) FROM player_ranks JOIN allowed USING (player_id) JOIN ready USING (request_id) JOIN asked USING (request_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY v DESC, a, b, c) AS nth, count(*) OVER (PARTITION BY request_id) AS n FROM ranked JOIN (SELECT request_id, "limit", request_type, player_given FROM asked) USING (request_id))"""


def _mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.lower("c_mktsegment").alias("x"))
    query = F.coalesce(*[F.when(F.col("k") % 9 == i, F.expr(f"concat({q})")) for i, q in enumerate(_KINDS)])
    fixed = spark.createDataFrame([(f"f{i}", q) for i, q in enumerate(_FIXED)], "request_id string, query string")
    return fixed.unionByName(c.select(F.concat(F.lit("c"), "k").alias("request_id"), query.alias("query")))


def _log_answers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def make() -> dict[str, DataFrame]:
        rows, states = batch.answer_log(_mixed_log(spark, sf_dir), _tables(spark, sf_dir), _lands(spark))
        return {"rows": storage.staged(rows, "answers"), "states": storage.staged(states, "answer-states")}

    return _written(spark, sf_dir, "log", make)


@_query(published(f"""SELECT request_id, request_type, coalesce(given, nth) AS rank, a AS name, if(request_type IN ('runs', 'records') AND player_given = 1, NULL, player) AS player, place, {round_("v")} AS points
    FROM numbered WHERE nth <= numbered."limit" """, _ANSWERS))
def answered_log(spark, sf_dir):
    """Requests of all types, one for each customer, answered by one scan of the runs."""
    return _log_answers(spark, sf_dir)["rows"]


@_query(published("""SELECT s.request_id, s.request_type, s."limit", least(coalesce(n, 0), s."limit")::BIGINT AS n_rows, coalesce(n > s."limit", false) AS truncated, s.n_warnings + coalesce(w.lost, 0) AS n_warnings
    FROM settings s LEFT JOIN (SELECT request_id, any_value(n) AS n FROM numbered GROUP BY 1) x USING (request_id)
    LEFT JOIN (SELECT request_id, count(*) AS lost FROM (SELECT request_id, box, sign, term FROM matches GROUP BY ALL HAVING count(id) = 0) GROUP BY 1) w USING (request_id)""", _ANSWERS))
def answered_log_states(spark, sf_dir):
    return _log_answers(spark, sf_dir)["states"].withColumn("n_warnings", F.size("warnings").cast("long")).drop("warnings")


_NEEDLES = ["game 1", "GAME2", "%", "old"]
_PLACES = ["nation 1", "build", "xa", "r1", "an"]


def _needles(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "needle string")


@_query(published(f"""SELECT needle, name, slug, nth::INTEGER AS nth FROM (
    SELECT needle, name, slug, row_number() OVER (PARTITION BY needle ORDER BY starts_with(name_lower, lower(needle)) DESC, starts_with(coalesce(slug_lower, ''), lower(needle)) DESC, length(name), name, id) AS nth
    FROM games JOIN (SELECT unnest({_NEEDLES}) AS needle) n ON contains(name_lower, lower(needle)) OR starts_with(slug_lower, lower(needle))) WHERE nth <= 10"""))
def suggest_names(spark, sf_dir):
    return requests.suggest_names(_tables(spark, sf_dir)["games"], _needles(spark, _NEEDLES))


@_query(published(f"""SELECT needle, name, slug, nth::INTEGER AS nth FROM (
    SELECT needle, name, slug, row_number() OVER (PARTITION BY needle ORDER BY o1, o2, o3, o4, o5) AS nth FROM (
        SELECT needle, continent AS name, code AS slug, 0 AS o1, 0 AS o2, 0 AS o3, code AS o4, code AS o5 FROM (SELECT DISTINCT code, continent FROM lands) l JOIN (SELECT unnest({_PLACES}) AS needle) n ON contains(lower(continent), needle) OR lower(code) = needle
        UNION ALL SELECT needle, coalesce(full_name, name), CASE WHEN id_lower NOT IN (SELECT lower(code) FROM lands) THEN id END, if(starts_with(name_lower, needle), 1, 2), length(id) - length(replace(id, '/', '')), length(name), name, id
        FROM areas JOIN (SELECT unnest({_PLACES}) AS needle) n ON starts_with(name_lower, needle) OR starts_with(lower(full_name), needle) OR contains(name_lower, ' ' || needle) OR id_lower = needle)) WHERE nth <= 10"""))
def suggest_locations(spark, sf_dir):
    return requests.suggest_locations(_tables(spark, sf_dir)["areas"], _lands(spark), _needles(spark, _PLACES))


_TYPED = """typed AS (SELECT DISTINCT q FROM (SELECT unnest([n_name[1:1 + n_nationkey % 3], concat('#', lpad((n_nationkey % 2)::VARCHAR, 4, '0')), concat(n_nationkey, 0), concat('Customer#0000', lpad(n_nationkey::VARCHAR, 4, '0')), 'c', 'er#', concat('s', lpad(n_nationkey::VARCHAR, 7, '0'))]) AS q FROM nation))"""


@_query(published("""SELECT needle, name, slug, nth::INTEGER AS nth FROM (
    SELECT q AS needle, name, slug, row_number() OVER (PARTITION BY q ORDER BY starts_with(name_lower, lower(q)) DESC, starts_with(coalesce(slug_lower, ''), lower(q)) DESC, length(name), name, id) AS nth
    FROM players JOIN typed ON contains(name_lower, lower(q)) OR starts_with(slug_lower, lower(q))) WHERE nth <= 10""", _TYPED))
def suggest_players(spark, sf_dir):
    """Needles made from nations, among them letters that nearly all players' names hold, by a written index."""
    players = _tables(spark, sf_dir)["players"]
    index = _written(spark, sf_dir, "suggest", lambda: {"players": storage.staged(requests.name_index(players), "suggest-players")})["players"]
    k = F.col("n_nationkey")
    padded = F.lpad(k.cast("string"), 4, "0")
    words = F.array(F.expr("left(n_name, 1 + n_nationkey % 3)"), F.concat(F.lit("#"), F.lpad((k % 2).cast("string"), 4, "0")), F.concat(k, F.lit(0)), F.concat(F.lit("Customer#0000"), padded), F.lit("c"), F.lit("er#"), F.concat(F.lit("s000"), padded))
    needles = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.explode(words).alias("needle")).distinct()
    return requests.suggest_names(players, needles, index=index)


@_query(published('SELECT DISTINCT p.name, p.flag, a.lb_name AS flag_name, color1, color2 FROM players p LEFT JOIN areas a ON a.id = p.flag WHERE (p.flag IS NOT NULL OR color1 IS NOT NULL) AND p.name IN (SELECT player FROM player_ranks WHERE rank <= 1001)'))
def player_styles(spark, sf_dir):
    t = _tables(spark, sf_dir)
    names = requests.player_rankings(t, Scope()).select(F.col("Player").alias("name"))
    return requests.player_styles(names, t["players"], t["areas"])


@_query(published("SELECT DISTINCT name, slug FROM players WHERE slug IS NOT NULL AND slug <> name AND name IN (SELECT player FROM player_ranks WHERE rank <= 1001)"))
def cell_slugs(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return requests.cell_slugs(requests.player_rankings(t, Scope()).select(F.col("Player").alias("name")), t["players"])


# -- quality ---------------------------------------------------------------------------------------------------------


@_query(published(f"""SELECT count(*) FILTER (player IS NULL OR leaderboard IS NULL OR game IS NULL OR value IS NULL) AS null_keys, count(*) FILTER (value < 0 OR place < 1) AS bad_values,
    count(*) - count(DISTINCT (leaderboard_id, player_id)) AS duplicates, count(*) FILTER (player IN ({", ".join(f"'{x}'" for x in race_view.EXCLUDED_PLAYERS)})) AS excluded_rows, {round_("sum(value)", 1)} AS total_value FROM runs"""))
def dq_row_checks(spark, sf_dir):
    return _rounded(quality.row_checks(_tables(spark, sf_dir)["runs"], race_view.EXCLUDED_PLAYERS), total_value=1)


def _previous(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """An older snapshot to compare with: the runs of all games but a few, ranked anew."""
    runs = t["runs"].where(~F.col("game_id").isin("g3", "g6"))
    ranks = publish.player_ranks(runs)
    old = t["games"].where(~F.col("id").isin("g3", "g6"))
    meta = runs.agg(F.lit("v0").alias("data_version"), F.count("*").alias("row_count")).crossJoin(old.agg(F.count("*").alias("game_count"))).crossJoin(ranks.agg(F.count("*").alias("player_count")))
    return {"runs": runs, "player_ranks": ranks, "meta": meta}


_PREVIOUS = f"""old_runs AS (SELECT * FROM runs WHERE game_id NOT IN ('g3', 'g6')),
old_points AS (SELECT player_id, max(player) AS player, round({_POINTS}, 6) AS points FROM old_runs GROUP BY player_id),
old_ranks AS (SELECT row_number() OVER (ORDER BY points DESC, player, player_id) AS rank, * FROM old_points),
m AS ({_META}),
c AS (SELECT (SELECT count(*) FROM old_runs) AS o_rows, (SELECT count(*) FROM games WHERE id NOT IN ('g3', 'g6')) AS o_games, (SELECT count(*) FROM old_ranks) AS o_players, (SELECT sum(value) FROM runs) / (SELECT sum(value) FROM old_runs) AS ratio,
    (SELECT count(*) FROM player_ranks n JOIN old_ranks o USING (player_id) WHERE n.rank <= 100 AND o.rank <= 100) AS overlap, (SELECT count(*) FROM runs WHERE game = 'Game 1') AS smoke,
    (SELECT count(*) FROM player_ranks WHERE player_id IN (SELECT player_id FROM runs WHERE game = 'Game 1')) AS smoke_players)"""

_FIRST_GATES = [("enough_boards", "leaderboard_count >= 100", "leaderboard_count"), ("few_failed_games", "errored_games <= 25 AND errored_games <= 0.001 * game_count", "errored_games"), ("keys_present", "true", "0"), ("ranges_kept", "true", "0"), ("credits_unique", "true", "0"), ("exclusions_kept", "true", "0"), ("known_game_has_runs", "smoke > 0", "smoke"), ("known_game_has_players", "smoke_players > 0", "smoke_players")]
_LATER_GATES = [("row_count_share", "row_count >= 0.9 * o_rows", "row_count / o_rows"), ("game_count_share", "game_count >= 0.95 * o_games", "game_count / o_games"), ("player_count_share", "player_count >= 0.9 * o_players", "player_count / o_players"), ("value_share", "ratio BETWEEN 0.85 AND 1.15", "ratio"), ("top_players_shared", "overlap >= 70", "overlap")]


def _gates_sql(gates: list[tuple[str, str, str]]) -> str:
    return published(" UNION ALL ".join(f"SELECT '{n}' AS name, {ok} AS ok, printf('%.3f', ({d})::DOUBLE) AS detail FROM m, c" for n, ok, d in gates), _PREVIOUS)


@_query(_gates_sql(_FIRST_GATES + _LATER_GATES))
def dq_vs_previous(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return quality.run_gates(t, _previous(t), race_view.EXCLUDED_PLAYERS, "Game 1", min_leaderboards=100)


@_query(_gates_sql([*_FIRST_GATES, ("first_snapshot", "true", "0")]))
def dq_first(spark, sf_dir):
    return quality.run_gates(_tables(spark, sf_dir), None, race_view.EXCLUDED_PLAYERS, "Game 1", min_leaderboards=100)


@_query(published(f"SELECT row_count - o_rows AS row_delta, {round_('ratio', 6)} AS value_ratio, overlap AS top_overlap FROM m, c", _PREVIOUS))
def dq_stats(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return _rounded(quality.snapshot_stats(t, _previous(t)), value_ratio=6)


@_query(published(f"SELECT data_version, row_count, raw_run_count, game_count, leaderboard_count, player_count, errored_games, 'v0' AS previous_version, row_count - o_rows AS row_delta, {round_('ratio', 6)} AS value_ratio, overlap AS top_overlap FROM m, c", _PREVIOUS))
def dq_report(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return _rounded(quality.report_stats(t, _previous(t)), value_ratio=6).drop("schema_version", "scraped_at", "published_at")


@_query(published("SELECT overlap FROM c", _PREVIOUS))
def dq_top100(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return quality.top_overlap(t["player_ranks"], _previous(t)["player_ranks"])


@_query(published("""SELECT 'a' AS side, * FROM (SELECT leaderboard, player_id, place FROM runs WHERE place <= 3 EXCEPT SELECT leaderboard, player_id, place FROM runs WHERE value > 50)
    UNION ALL SELECT 'b', * FROM (SELECT leaderboard, player_id, place FROM runs WHERE value > 50 EXCEPT SELECT leaderboard, player_id, place FROM runs WHERE place <= 3)"""))
def snapshot_diff(spark, sf_dir):
    runs = _tables(spark, sf_dir)["runs"]
    of = lambda cond: runs.where(cond).select("leaderboard", "player_id", "place")
    return ranking.symmetric_difference(of("place <= 3"), of("value > 50"))


# -- ingest ----------------------------------------------------------------------------------------------------------


@_query(sql("SELECT concat('g', k) AS id FROM g WHERE k % 17 = 0 AND k <> 17"))
def pending_work(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return payloads.pending(raw["raw_game_list"].unionByName(raw["raw_game_list"]), raw["crawl_checkpoint"], ["g17"])


@_query(sql("SELECT ord, run_id, game_id FROM raw_runs WHERE game_id IN (SELECT game_id FROM checkpoint WHERE status = 'done') AND category_id NOT IN ('g1-A', 'g2-N')"))
def drop_partial(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    kept = payloads.without_partial(raw["raw_runs"], raw["crawl_checkpoint"])
    return payloads.included(kept, ["g1-A", "g2-N"], "category_id").select("ord", "run_id", "game_id")


@_query(sql("SELECT ord, run_id, game_id FROM raw_runs WHERE game_id IN (SELECT game_id FROM checkpoint WHERE status = 'done')"))
def drop_partial_stored(spark, sf_dir):
    """From a stored table, of which only the parts with such rows are written anew."""
    raw, path = _raw(spark, sf_dir), _shared(spark, "raw-runs")
    payloads.write_raw_runs(raw["raw_runs"], path)
    payloads.drop_partial_rows(spark, path, raw["crawl_checkpoint"])
    return spark.read.parquet(path).select("ord", "run_id", "game_id")


@_query(sql("SELECT ord, run_id, game_id FROM raw_runs WHERE game_id NOT IN (SELECT game_id FROM checkpoint WHERE status = 'error')"))
def drop_errored(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return payloads.without_partial(raw["raw_runs"], raw["crawl_checkpoint"], retry_errors_only=True).select("ord", "run_id", "game_id")


@_query(sql("SELECT id, game_id, name, time_direction::INTEGER AS time_direction FROM raw_categories WHERE id NOT IN ('g1-A', 'g2-N')"))
def included_categories(spark, sf_dir):
    rows = payloads.included(_raw(spark, sf_dir)["raw_categories"], ["g1-A", "g2-N"])
    return rows.select("id", "game_id", "name", F.col("time_direction").cast("int").alias("time_direction"))


def _seen():
    return F.lit("2024-01-08 00:00:00").cast("timestamp").alias("seen_at")


#: Parts as games: some lists, numbers and flags are absent, names have blanks around.
_PARTS = """p AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size FROM part)"""


def _game_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each part: the part as a game, its brand as a category, its type as a level, its container as a value."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    third, even = k % 3 == 0, k % 2 == 0
    game = F.struct(F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit(" \t"), "p_name", F.lit(" \n")).alias("name"), F.concat(F.lit("part-"), k).alias("url"), F.when(third, (k % 5).cast("string")).alias("defaultTimer"))
    direction = F.when(even, F.lit("1"))
    category = F.struct(F.concat(F.lit("c"), k).alias("id"), F.concat(F.lit(" "), "p_brand").alias("name"), direction.alias("timeDirection"), F.when(third, F.lit(True)).alias("archived"))
    variable = F.struct(F.concat(F.lit("w"), k).alias("id"), F.lit("Container").alias("name"), F.when(even, F.lit(True)).alias("isSubcategory"), F.lit(None).cast("boolean").alias("archived"))
    value = F.struct(F.concat(F.lit("v"), k).alias("id"), F.concat(F.lit("w"), k).alias("variableId"), F.concat(F.lit("Box "), "p_size").alias("name"))
    level = F.struct(F.concat(F.lit("l"), k).alias("id"), F.concat("p_type", F.lit("  ")).alias("name"))
    platform = F.struct(F.concat(F.lit("s"), F.col("p_size")).alias("id"), F.concat(F.lit("Size "), "p_size").alias("name"), F.concat(F.lit("size-"), "p_size").alias("url"))
    doc = F.struct(game.alias("game"), F.array(category).alias("categories"), F.when(~third, F.array(level)).alias("levels"), F.array(variable).alias("variables"), F.array(value).alias("values"), F.when(even, F.array(platform)).alias("platforms"))
    return p.select(F.to_json(doc).alias("payload"), _seen())


@_query(f"""WITH {_PARTS}
    SELECT 'games' AS kind, concat('p', k) AS id, trim(p_name) AS name, concat('part-', k) AS other, if(k % 3 = 0, k % 5, 0)::INTEGER AS number, NULL::BOOLEAN AS flag FROM p
    UNION ALL SELECT 'categories', concat('c', k), trim(p_brand), concat('p', k), (k % 2 = 0)::INTEGER, k % 3 = 0 FROM p
    UNION ALL SELECT 'levels', concat('l', k), trim(p_type), concat('p', k), NULL, NULL FROM p WHERE k % 3 <> 0
    UNION ALL SELECT 'variables', concat('w', k), 'Container', concat('p', k), 0, k % 2 = 0 FROM p
    UNION ALL SELECT 'values', concat('v', k), concat('Box ', p_size), concat('w', k), NULL, NULL FROM p
    UNION ALL SELECT 'platforms', concat('s', p_size), concat('Size ', p_size), concat('size-', p_size), NULL, NULL FROM p WHERE k % 2 = 0""")
def ingest_games(spark, sf_dir):
    t = payloads.parse_game_payloads(_game_payloads(spark, sf_dir))
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        ("games", t["raw_games"], "url", F.col("default_timer").cast("int"), none("boolean")),
        ("categories", t["raw_categories"], "game_id", F.col("time_direction").cast("int"), F.col("archived")),
        ("levels", t["raw_levels"], "game_id", none("int"), none("boolean")),
        ("variables", t["raw_variables"], "game_id", F.col("archived").cast("int"), F.col("is_subcategory")),
        ("values", t["raw_values"], "variable_id", none("int"), none("boolean")),
        ("platforms", t["raw_platforms"], "url", none("int"), none("boolean")),
    ]
    out = None
    for kind, df, other, number, flag in parts:
        rows = df.select(F.lit(kind).alias("kind"), "id", "name", F.col(other).alias("other"), number.alias("number"), flag.alias("flag"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(f"""WITH {_PARTS},
    r AS (SELECT k, CASE k % 11 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'wrong type' WHEN 3 THEN 'empty' WHEN 4 THEN 'nothing needed' WHEN 5 THEN 'not JSON' WHEN 6 THEN 'empty' WHEN 7 THEN 'wrong type' END AS reason FROM p)
    SELECT concat('p', k) AS game_id, 'read' AS outcome, NULL AS payload_sha256 FROM r WHERE reason IS NULL
    UNION ALL SELECT concat('p', k), reason, CASE k % 11 WHEN 4 THEN sha256('{{"other": [1]}}') WHEN 5 THEN sha256('none') WHEN 6 THEN sha256('  ') WHEN 7 THEN sha256('[1, 2]') END FROM r WHERE reason IS NOT NULL""")
def ingest_quarantine(spark, sf_dir):
    """Game payloads of which some are cut, wrongly typed, absent or about something else: each is read or in quarantine."""
    rows = _game_payloads(spark, sf_dir)
    kind = F.regexp_extract("game_id", "[0-9]+", 0).cast("int") % 11
    rows = rows.withColumn("game_id", F.get_json_object("payload", "$.game.id"))
    broken = F.when(kind == 1, F.expr("left(payload, length(payload) - 9)")).when(kind == 2, F.regexp_replace("payload", '"variables":.*', '"variables":"none"}')).when(kind == 4, '{"other": [1]}').when(kind == 5, "none").when(kind == 6, "  ").when(kind == 7, "[1, 2]").when(kind != 3, F.col("payload"))
    t = payloads.parse_game_payloads(rows.withColumn("payload", broken))
    hash_ = F.when(F.regexp_extract("game_id", "[0-9]+", 0).cast("int") % 11 > 3, F.col("payload_sha256"))
    read = t["raw_games"].select(F.col("id").alias("game_id"), F.lit("read").alias("outcome"), F.lit(None).cast("string").alias("payload_sha256"))
    return read.unionByName(t["quarantine"].select("game_id", F.col("reason").alias("outcome"), hash_.alias("payload_sha256")))


@_query("""SELECT 'area' AS kind, concat('n', n_nationkey) AS id, n_name AS name, if(n_nationkey % 3 = 0, n_name, concat('Board ', n_name)) AS lb_name, concat('flag/', n_nationkey) AS flag, if(n_nationkey % 2 = 0, concat('r', n_regionkey), NULL) AS parent_id FROM nation
    UNION ALL SELECT 'color', concat('m', c_custkey), c_mktsegment, concat('#', c_nationkey), NULL, NULL FROM customer""")
def ingest_static(spark, sf_dir):
    """Nations as areas (the board name absent, empty or given; the flag under either key), customers as colours."""
    n, c = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("n_nationkey")
    icon = F.concat(F.lit("/images/flags/flag/"), k, F.lit(".png"))
    board = F.when(k % 3 != 0, F.concat(F.lit("Board "), "n_name")).when(k % 2 == 0, F.lit(""))
    area = F.struct(F.concat(F.lit("n"), k).alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("fullName"), board.alias("lbName"), F.when(k % 4 == 0, icon).alias("lbFlag"), F.when(k % 4 != 0, F.struct(icon.alias("path"))).alias("flagIcon"), F.when(k % 2 == 0, F.concat(F.lit("r"), "n_regionkey")).alias("parentId"))
    color = F.struct(F.concat(F.lit("m"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("#"), "c_nationkey").alias("darkColor"), F.lit("#000").alias("lightColor"))
    rows = n.select(F.to_json(F.struct(F.array(area).alias("areas"))).alias("payload"), _seen()).unionByName(c.select(F.to_json(F.struct(F.array(color).alias("colors"))).alias("payload"), _seen()))
    t = payloads.parse_static_payloads(rows)
    none = F.lit(None).cast("string")
    areas = t["raw_areas"].select(F.lit("area").alias("kind"), "id", "name", "lb_name", F.col("lb_flag").alias("flag"), "parent_id")
    return areas.unionByName(t["raw_colors"].select(F.lit("color").alias("kind"), "id", "name", F.col("dark").alias("lb_name"), none.alias("flag"), none.alias("parent_id")))


@_query("""SELECT 'game' AS kind, concat('p', p_partkey) AS id, trim(p_name) AS name, concat('part-', p_partkey) AS other FROM part
    UNION ALL SELECT 'member', concat('p', p_partkey), NULL, concat('b', p_brand) FROM part WHERE p_partkey % 4 <> 0
    UNION ALL SELECT 'series', concat('x', s_suppkey), s_name, concat('supplier-', s_suppkey) FROM supplier""")
def ingest_lists(spark, sf_dir):
    """Parts as game lists of both shapes, most listed for a series (their brand), suppliers as a series list."""
    p, s = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("p_partkey")
    key, name, url = F.concat(F.lit("p"), k), F.concat(F.lit(" "), "p_name", F.lit(" ")), F.concat(F.lit("part-"), k)
    new = F.to_json(F.struct(F.array(F.struct(key.alias("id"), name.alias("name"), url.alias("url"))).alias("gameList")))
    old = F.to_json(F.struct(F.array(F.struct(key.alias("id"), F.struct(name.alias("international")).alias("names"), url.alias("abbreviation"))).alias("data")))
    games = p.select(F.when(k % 2 == 0, new).otherwise(old).alias("payload"), _seen(), F.when(k % 4 != 0, F.concat(F.lit("b"), "p_brand")).alias("series_id"))
    series = F.struct(F.concat(F.lit("x"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("supplier-"), "s_suppkey").alias("url"))
    lists = s.select(F.to_json(F.struct(F.array(series).alias("seriesList"))).alias("payload"), _seen(), F.lit(None).cast("string").alias("series_id"))
    t = payloads.parse_list_payloads(games.unionByName(lists))
    out = t["raw_game_list"].select(F.lit("game").alias("kind"), "id", "name", F.col("url").alias("other"))
    out = out.unionByName(t["raw_game_series"].select(F.lit("member").alias("kind"), F.col("game_id").alias("id"), F.lit(None).cast("string").alias("name"), F.col("series_id").alias("other")))
    return out.unionByName(t["raw_series"].select(F.lit("series").alias("kind"), "id", "name", F.col("url").alias("other")))


def _page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they would land: one of each order, alternating between both shapes; values in both notations."""
    raw = race_view.raw_tables(spark, sf_dir, ordered=False)["raw_runs"]
    order = F.split("run_id", "-")[0].cast("long")
    odd = order % 2 == 1
    second = F.when(F.col("time").isNotNull(), F.when(odd, F.concat(F.format_string("%.3f", "time"), F.lit("s"))).otherwise(F.col("time").cast("string")))
    when = F.when(odd, F.date_format(F.timestamp_seconds("date"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col("date").cast("string"))
    run = F.struct(F.col("run_id").alias("id"), F.col("game_id").alias("gameId"), F.col("category_id").alias("categoryId"), F.col("level_id").alias("levelId"), F.when(~odd, F.col("value_ids")).alias("valueIds"), F.col("player_ids").alias("playerIds"), F.col("platform_id").alias("platformId"), second.alias("time"), when.alias("performedAt"))
    pages = raw.groupBy(order.alias("page")).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    one = F.to_json(F.struct(F.struct("runs", F.array().cast("array<struct<id:string>>").alias("players")).alias("leaderboard")))
    two = F.to_json(F.struct(F.col("runs").alias("runList")))
    return pages.select(F.when(F.col("page") % 3 == 0, two).otherwise(one).alias("payload"), F.lit("2024-01-08 00:00:00").cast("timestamp").alias("seen_at"), (F.col("page") % 2).alias("batch"), "page")


@_query(sql("""SELECT run_id, game_id, category_id, level_id, CASE WHEN o % 2 = 1 THEN '' ELSE array_to_string(value_ids, '|') END AS value_ids, array_to_string(player_ids, '|') AS player_ids, platform_id, time, date, CASE WHEN o % 3 = 0 THEN 2 ELSE 1 END AS lb_type, n AS runs_before_page
    FROM (SELECT *, split_part(run_id, '-', 1)::BIGINT AS o FROM raw_runs) r JOIN (SELECT o, sum(n) OVER (ORDER BY o % 2, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, coalesce(before, 0)::BIGINT AS n FROM (SELECT split_part(run_id, '-', 1)::BIGINT AS o, count(*) AS n FROM raw_runs GROUP BY 1)) p USING (o)"""))
def ingest_payloads(spark, sf_dir):
    runs = payloads.with_ord(payloads.parse_page_payloads(_page_payloads(spark, sf_dir))["raw_runs"])
    before = F.min("ord").over(ranking.Window.partitionBy("page"))
    return runs.select("run_id", "game_id", "category_id", "level_id", F.array_join("value_ids", "|").alias("value_ids"), F.array_join("player_ids", "|").alias("player_ids"), "platform_id", "time", "date", F.col("lb_type").cast("int").alias("lb_type"), before.alias("runs_before_page"))


@_query("SELECT max(n) AS next_ord FROM (SELECT count(*) AS n FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)")
def resume_ord(spark, sf_dir):
    return payloads.next_ord(_raw(spark, sf_dir)["raw_runs"])


_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream_source(sf_dir: str) -> str:
    return f"{sf_dir}/events*.parquet"


@_query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, max(ts) AS last_ts FROM events GROUP BY 1")
def stream_ingest(spark, sf_dir):
    out = _shared(spark, "stream")
    ingest.start_ingest(spark, _stream_source(sf_dir), f"{out}/rows", f"{out}/checkpoint", _EVENTS).awaitTermination()
    return spark.read.schema(_EVENTS).parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.max("ts").alias("last_ts"))


@_query("SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def stream_progress(spark, sf_dir):
    out = _shared(spark, "progress")
    step = lambda batch: batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", F.col("x.ts").alias("last_ts"), F.col("x.event_type").alias("status"))
    ingest.start_progress(spark, _stream_source(sf_dir), out, f"{out}/checkpoint", _EVENTS, step, "user_id", "last_ts").awaitTermination()
    return ingest.latest_progress(spark, out, "user_id", "last_ts").select("user_id", "last_ts", "status")


# -- snapshots -------------------------------------------------------------------------------------------------------


@_query(published("SELECT leaderboard_id, leaderboard, player_id, place, value, date FROM runs"))
def snapshot_roundtrip(spark, sf_dir):
    root = _shared(spark, "snapshots")
    publish.write_snapshot(_tables(spark, sf_dir), root, "2024-01-08")
    return publish.read_snapshot(spark, root)["runs"].select("leaderboard_id", "leaderboard", "player_id", "place", "value", "date")


def before_last_runs(spark: SparkSession, sf_dir: str) -> Callable[[], dict[str, DataFrame]]:
    """Writes a snapshot of all but the last hundredth of the runs, with its state; what is returned publishes again from it."""
    raw, root = _current(spark, sf_dir), _shared(spark, "before")
    n = raw["raw_runs"].agg(F.max("ord")).first()[0] or 0
    tables, state = increment.publish_whole(raw | {"raw_runs": raw["raw_runs"].where(F.col("ord") <= n - n // 100)}, at=f"{root}/version=1")
    publish.write_snapshot(tables, root, "1", placed=("runs",))
    increment.write_state(state, root, "1")
    return lambda: increment.publish_again(raw, publish.read_snapshot(spark, root), increment.read_state(spark, root, "1"))[0]


def _republished(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _written(spark, sf_dir, "republished", lambda: before_last_runs(spark, sf_dir)())


@_query(published("SELECT * FROM runs"))
def republished_runs(spark, sf_dir):
    return _republished(spark, sf_dir)["runs"]


@_query(published(f"SELECT rank, player_id, player, country, flag, {round_('points', 3)} AS points FROM player_ranks"))
def republished_ranks(spark, sf_dir):
    return _rounded(_republished(spark, sf_dir)["player_ranks"], points=3)


@_query(published("SELECT leaderboard, player, place, value, platform, date, flag FROM runs"))
def csv_roundtrip(spark, sf_dir):
    out = _shared(spark, "golden")
    rows = _tables(spark, sf_dir)["runs"].select("leaderboard", "player", "place", "value", "platform", "date", "flag")
    rows.orderBy("leaderboard", "place", "player").write.option("header", True).csv(out)
    return spark.read.schema(rows.schema).option("header", True).csv(out)


@_query(normal("SELECT 'raw_games' AS name, id, url FROM raw_games UNION ALL SELECT 'raw_levels', id, NULL FROM raw_levels"))
def fixture_load(spark, sf_dir):
    """Documents of about a thousand rows each, written and read again."""
    raw, out = _raw(spark, sf_dir), _shared(spark, "document")
    for name in ("raw_games", "raw_levels"):
        parts = F.pmod(F.xxhash64("id"), F.lit(raw[name].count() // 1000 + 1))
        raw[name].groupBy(parts.alias("part")).agg(F.collect_list(F.struct("*")).alias(name)).drop("part").write.mode("append").json(out)
    schemas = {"raw_games": "id: string, name: string, url: string, default_timer: tinyint, seen_at: timestamp", "raw_levels": "id: string, game_id: string, name: string, seen_at: timestamp", "raw_areas": "id: string"}
    t = payloads.load_document(spark, out, schemas, lines=True)
    return t["raw_games"].select(F.lit("raw_games").alias("name"), "id", "url").unionByName(t["raw_levels"].select(F.lit("raw_levels").alias("name"), "id", F.lit(None).cast("string").alias("url")))


# -- whole requests and the real continents --------------------------------------------------------------------------

_CODES = sorted(a for ids in resolve.CONTINENT_COUNTRIES.values() for a in ids.split())
_ISO = f"""iso AS (SELECT n_nationkey, ([{", ".join(f"'{c}'" for c in _CODES)}])[(n_nationkey * 9 % {len(_CODES)} + 1)::INTEGER] AS id FROM nation),
real_lands AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{n}', '{a}')" for c, n in resolve.CONTINENT_NAMES.items() for a in resolve.CONTINENT_COUNTRIES[c].split())}) x(code, continent, area_id)),
wanted AS (SELECT 'q' || c_custkey AS request_id, if(c_custkey % 5 = 0, '!', '') AS sign, (['EU', 'north america', 'Asia', 'af', 'Oceania', 'sa', 'Nowhere'])[(c_custkey % 7 + 1)::INTEGER] AS term FROM customer),
land_ids AS (SELECT DISTINCT request_id, sign, area_id FROM wanted JOIN real_lands ON lower(term) IN (lower(code), lower(continent)))"""


@_query(f"""WITH {_ISO}
    SELECT request_id, sign, area_id AS id FROM land_ids
    UNION SELECT request_id, sign, concat(iso.id, '/', n_nationkey) FROM land_ids JOIN iso ON iso.id = area_id""")
def continent_areas(spark, sf_dir):
    """Terms of customers against the shipped map: the countries of a continent, and the areas below those that exist."""
    nation, customer = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    codes = F.array(*map(F.lit, _CODES))
    land = nation.select(F.element_at(codes, (F.col("n_nationkey") * 9 % len(_CODES) + 1).cast("int")).alias("id"), "n_nationkey", "n_name")
    every = land.select("id", F.col("n_name").alias("name")).unionByName(land.select(F.concat_ws("/", "id", "n_nationkey").alias("id"), F.lit("below").alias("name")))
    areas = every.select("id", "name", F.col("name").alias("full_name"), F.lower("id").alias("id_lower"), F.lower("name").alias("name_lower"))
    term = F.element_at(F.array(*map(F.lit, ("EU", "north america", "Asia", "af", "Oceania", "sa", "Nowhere"))), (F.col("c_custkey") % 7 + 1).cast("int"))
    log = customer.select(F.concat(F.lit("q"), "c_custkey").alias("request_id"), F.concat(F.lit("l="), F.when(F.col("c_custkey") % 5 == 0, "!").otherwise(""), F.replace(term, F.lit(" "), F.lit("+"))).alias("query"))
    return resolve.location_ids(resolve.request_terms(log), areas, resolve.continents(spark))


_ASKED = "g=game3,!Game+2&s=t-1&l=!r0/n0,XB&u=!Customer%23000000007&r=games&m=4"


@_query(published(f"""SELECT * , (SELECT count(*) FROM chosen) > 4 AS truncated FROM (SELECT row_number() OVER (ORDER BY points DESC, game) AS "Rank", game AS "Game", {round_("points")} AS "Points" FROM chosen) WHERE "Rank" <= 4""",
    """chosen AS (SELECT game, round(sum(value), 6) AS points FROM runs
    WHERE (game_id = 'g3' OR game_id IN (SELECT game_id FROM game_series WHERE series_id = 't1')) AND game_id <> 'g2' AND player <> 'Customer#000000007'
      AND player_id IN (SELECT id FROM players WHERE split_part(area_id, '/', 1) IN ('r2', 'r3') AND area_id <> 'r0/n0' AND NOT starts_with(area_id, 'r0/n0/')) GROUP BY game)"""))
def answered_request(spark, sf_dir):
    """A query string from its text to its answer."""
    return answers.answer_query(_ASKED, _tables(spark, sf_dir), _lands(spark))[0]


@_query(published("SELECT name, ok, n_runs FROM (SELECT unnest(['enough_boards', 'few_failed_games', 'keys_present', 'ranges_kept', 'credits_unique', 'exclusions_kept', 'known_game_has_runs', 'known_game_has_players', 'first_snapshot']) AS name, unnest([leaderboard_count >= 100, false, true, true, true, true, true, true, true]) AS ok, 0::BIGINT AS n_runs FROM m)", _PREVIOUS))
def publish_refused(spark, sf_dir):
    """A gate fails (too many failed games), so no snapshot is written."""
    root = _shared(spark, "gated")
    gates = publish.publish_checked(_tables(spark, sf_dir), root, "2024-01-08", race_view.EXCLUDED_PLAYERS, "Game 1", 100)
    try:
        n = publish.read_snapshot(spark, root)["runs"].count()
    except LookupError:
        n = 0
    return gates.select("name", "ok", F.lit(n).cast("long").alias("n_runs"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
