"""What queries leave undone that they don't need, and rows that cross the network once."""

import pytest

from rankengine.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["continent_areas", "location_closure"])
def test_location_queries_make_no_snapshot(spark, monkeypatch, name):
    def refused(*_):
        raise AssertionError("a snapshot was asked for")

    monkeypatch.setattr(catalogue, "_tables", refused)
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_dropped_rows_are_not_shuffled_again(spark, monkeypatch, tmp_path):
    from pyspark.sql import DataFrame

    from rankengine.sources import payloads

    runs = spark.range(3000).selectExpr("id AS ord", "concat('g', id % 90) AS game_id")
    payloads.write_raw_runs(runs, f"file://{tmp_path}/runs")
    done = spark.range(90).selectExpr("concat('g', id) AS game_id", "IF(id % 7 = 0, 'error', 'done') AS status")

    def refused(*_):
        raise AssertionError("rows were dealt anew")

    monkeypatch.setattr(DataFrame, "repartition", refused)
    assert payloads.drop_partial_rows(spark, f"file://{tmp_path}/runs", done)
    left = spark.read.parquet(f"file://{tmp_path}/runs").select("ord", "game_id").collect()
    assert sorted(left) == sorted(r for r in runs.collect() if int(r.game_id[1:]) % 7)


def test_published_runs_are_numbered_and_clustered_by_one_shuffle(spark, monkeypatch):
    from rankengine.plans import publish

    frame, dealt, numbered = type(spark.range(1)), [], []
    by_range, dense = frame.repartitionByRange, publish.dense_ids
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, *by: dealt.append((str(by[-1]), df.columns)) or by_range(df, *by))
    monkeypatch.setattr(publish, "dense_ids", lambda df, *names: numbered.append(df.columns) or dense(df, *names))
    runs = catalogue.fresh_tables(spark, SF)["runs"]
    assert runs.count() and sum("value" in columns for _, columns in dealt) == 1
    assert numbered and not any("player_id" in columns for columns in numbered)
    for file in runs.inputFiles():  # a game's boards lie side by side, by name
        rows = [(r.game_id, r.leaderboard_id, r.place) for r in spark.read.parquet(file).select("game_id", "leaderboard_id", "place").collect()]
        assert rows == sorted(rows)


def test_boards_that_games_of_one_name_share(spark):
    from rankengine.plans import publish, score

    rows = [(i, f"r{i}", game, platform, players, board, False, float(t), False, 86400 * i, i, False) for i, (game, platform, players, board, t) in enumerate([("g1", "p", ["a", "b"], "B: x", 5), ("g2", None, ["b"], "B: x", 5), ("g2", "q", ["c", "a"], "B: x", 7), ("g3", "p", ["a"], "A: x", 3), ("g1", "p", ["x"], "B: y", 3), ("g1", "p", ["z"], "B: z", 3)])]
    scored = spark.createDataFrame(rows, "ord long, run_id string, game_id string, platform_id string, player_ids array<string>, leaderboard_name string, is_reverse boolean, t double, missing_primary boolean, date long, date_submitted long, is_level_run boolean")
    players = spark.createDataFrame([(i, i.upper(), "r", "f", i == "z") for i in "abcxz"], "id string, name string, country string, flag string, is_guest boolean")
    names = lambda *x: spark.createDataFrame([(*r, "2024-01-01") for r in x], "id string, name string, seen_at string")
    raw = {"raw_games": names(("g1", "B"), ("g2", "B"), ("g3", "A")), "raw_platforms": names(("p", "P")), "excluded_players": spark.createDataFrame([("X",), (None,)], "name string")}
    want = score.credit_runs(score.value_boards(scored), players, raw["raw_games"], raw["raw_platforms"], raw["excluded_players"])
    got = publish.published_runs(raw, scored, players).select(want.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want.collect()))
    assert sorted((r.leaderboard_id, r.game_id, r.player_id) for r in got) == [(1, "g3", "a"), (2, "g1", "a"), (2, "g1", "b"), (2, "g2", "c")]


def test_written_dimensions_are_not_reduced_again(spark):
    from rankengine.plans import normalize

    raw = catalogue._raw(spark, SF)
    current = normalize.current(raw)
    plan = normalize.scored_input(current)._jdf.queryExecution().executedPlan().toString()
    assert "seen_at" not in plan and "Aggregate" not in plan
    # another frame in a dimension's place is reduced again
    late = current | {"raw_games": raw["raw_games"]}
    assert isinstance(current | {"raw_runs": raw["raw_runs"]}, normalize.Current) and not isinstance(late, normalize.Current)
    assert normalize.latest(late, "raw_games").count() == current["raw_games"].count() < raw["raw_games"].count()


def test_runs_of_a_log_are_written_once_for_all_its_requests(spark, monkeypatch):
    from rankengine.plans import answers, batch

    monkeypatch.setattr(batch, "WORDS", 1)
    monkeypatch.setattr(batch, "CHUNK", 64)
    kept, staged = {}, batch.staged
    monkeypatch.setattr(batch, "staged", lambda df, name: kept.setdefault(name, staged(df, name)))
    tables, lands = catalogue._tables(spark, SF), catalogue._lands(spark)
    queries = {f"q{k}": f"g=game1&u=!C{k}&r=records&m=5" for k in range(150)}
    queries |= {"a": "g=!game2&r=pr&m=50", "b": "g=!game3&l=!r1&u=!C10&r=pr&m=20", "c": "p=high&r=pr&m=7", "d": "u=C10,C13&g=!game1&r=pr", "e": "l=r0&p=low,urgent&r=runs&m=9", "f": "p=!high&u=!C13&r=runs&m=13", "g": "s=t-1&l=!r2/n2&r=leaderboards&m=6"}
    rows, _ = batch.answer_log(spark.createDataFrame(list(queries.items()), "request_id string, query string"), tables, lands)
    # before: a row for each chunk of scopes, with names, and another table for scopes that include players or places
    assert kept["log-runs"].count() <= tables["runs"].count() and "leaderboard" not in kept["log-runs"].columns
    found = {}
    for r in rows.collect():
        found.setdefault(r.request_id, []).append((r.rank, r.name, r.points))
    for name in ("q7", *"abcdefg"):
        want = answers.answer_query(queries[name], tables, lands)[0].collect()
        shown = lambda w: w["Leaderboard"] if "Leaderboard" in w else w["Player"]
        assert want and sorted(found[name]) == sorted((w["Rank"], shown(w.asDict()), w["Points"]) for w in want), name


def test_points_of_groups_are_those_of_all_results(spark):
    from pyspark.sql import functions as F

    from rankengine.plans import publish

    runs = spark.range(900).selectExpr("concat('p', id % 3) AS player_id", "id % 7 AS part", "(id * 7919 % 10007) / 1000.0D AS value").where("player_id <> 'p2' OR part = 0")
    want = {r.player_id: r.points for r in publish.player_points(runs).collect()}
    groups = runs.groupBy("player_id", "part").agg(F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, publish.full_places()).alias("best"), F.sum("value").alias("total"), F.count("*").alias("n"))
    rows = groups.groupBy("player_id").agg(F.flatten(F.collect_list("best")).alias("best"), F.collect_list("total").alias("totals"), F.collect_list("n").alias("counts"))
    got = {r.player_id: r.points for r in rows.select("player_id", publish.points_of(F.col("best"), F.col("totals"), F.col("counts")).alias("points")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_publishing_again_leaves_what_is_written_where_it_is(spark, monkeypatch):
    from rankengine.plans import increment, normalize, publish

    catalogue._current(spark, SF)

    def refused(*_):
        raise AssertionError("dimensions were reduced again")

    monkeypatch.setattr(normalize, "latest_per_key", refused)
    names = []
    for module in (increment, publish):
        monkeypatch.setattr(module, "staged", lambda df, name, staged=module.staged: names.append(name) or staged(df, name))
    again = catalogue.before_last_runs(spark, SF)
    assert "scored" not in names  # it is written to its place in the state, once
    names.clear()
    tables = again()
    assert "late-credits" in names and "runs" not in names  # rows of other boards stay where they are
    columns = ["leaderboard_id", "leaderboard", "player_id", "player", "place", "value", "platform", "date"]
    rows = lambda t: sorted(map(str, t["runs"].select(columns).collect()))
    assert rows(tables) == rows(catalogue._tables(spark, SF))


def test_credits_are_made_single_before_players_are_met(spark):
    from rankengine.plans import score

    rows = [(i, f"r{i}", "g", "p", players, "B", False, float(i), False, 86400, i, False) for i, players in enumerate([["a", "b"], ["b"], ["b", "a"]])]
    scored = spark.createDataFrame(rows, "ord long, run_id string, game_id string, platform_id string, player_ids array<string>, leaderboard_name string, is_reverse boolean, t double, missing_primary boolean, date long, date_submitted long, is_level_run boolean")
    players = spark.createDataFrame([(i, i.upper(), "r", "f", False) for i in "ab"], "id string, name string, country string, flag string, is_guest boolean")
    named = spark.createDataFrame([("g", "G"), ("p", "P")], "id string, name string")
    credits = score.credit_runs(score.value_boards(scored), players, named, named, spark.createDataFrame([(None,)], "name string"), ids=False)
    assert sorted((r.player_id, r.place) for r in credits.collect()) == [("a", 1), ("b", 1)]
    plan = score.value_boards(scored)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, currentrow" in plan  # means over ties need no sort of their own


def test_first_rows_are_found_without_a_sort(spark):
    from rankengine.plans import batch

    df = spark.range(6000).selectExpr("id % 3 AS k", "id AS n", "CASE WHEN id % 3 = 2 THEN 1.5D WHEN id % 11 = 0 THEN 0D ELSE (id * 7919 % 10007) / 1000.0D END AS v")
    plan = batch._front(df, "v", 1500, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    rows = df.collect()
    for most in (0, 10, 1500):
        got = {(r.k, r.n) for r in batch._front(df, "v", most, "k").collect()}
        for k in range(3):
            mine = sorted((r for r in rows if r.k == k), key=lambda r: -r.v)
            last = mine[most].v
            assert {(k, r.n) for r in mine if r.v >= last} <= got and (k == 2 or sum(x == k for x, _ in got) < most + 40)
