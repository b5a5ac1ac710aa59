import duckdb
import pytest
from pyspark.sql import functions as F

from rankengine.functions.coercion import as_epoch, as_int, as_seconds
from rankengine.functions.numeric import round_half_away
from rankengine.operators import ranking, storage
from rankengine.plans import answers, catalogue, publish, quality, requests, resolve, scope, score
from rankengine.sources import payloads

SF = "/root/testdata/sf0.001"


def test_rounding_scales_in_binary(spark):
    rows = spark.createDataFrame([(0.145,), (-0.145,), (2.5,), (0.0,)], "x double").select(round_half_away(F.col("x"), 2).alias("y")).collect()
    assert [r.y for r in rows] == [duckdb.sql(f"SELECT sign({x}::DOUBLE) * floor(abs({x}::DOUBLE) * 100 + 0.5) / 100").fetchall()[0][0] for x in (0.145, -0.145, 2.5, 0.0)]


def test_coercions(spark):
    r = spark.createDataFrame([("7.25s", "2001-02-03T04:05:06Z", "981173106", "")], "a string, b string, c string, d string").select(as_seconds(F.col("a")).alias("s"), as_epoch(F.col("b")).alias("e"), as_int(F.col("c")).alias("i"), as_int(F.col("d")).alias("z"), as_seconds(F.col("d")).alias("n"), as_epoch(F.col("c")).alias("u")).first()
    assert (r.s, r.e, r.i, r.z, r.n, r.u) == (7.25, 981173106, 981173106, 0, None, 981173106)


def test_global_numbers_and_sums_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 700)
    # a third of the rows are equal in the first key, some have none
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 100 != 1, F.col("id") * 7919 % 9001).alias("v"), "id")
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = ranking.global_row_number(df, order, "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 9001)) and [r.id for r in got] == [r.id for r in df.orderBy(*order).collect()]
    sums, total = ranking.running(df, order, {"s": F.col("id")}).orderBy(*order).collect(), 0
    for r in sums:
        assert r.s == total
        total += r.id


def _board(spark, rows):
    return spark.createDataFrame([(i, f"r{i}", "g", None, p, "b", rev, t, False, d, d, False) for i, (p, t, d, rev) in enumerate(rows)], "ord long, run_id string, game_id string, platform_id string, player_ids array<string>, leaderboard_name string, is_reverse boolean, t double, missing_primary boolean, date long, date_submitted long, is_level_run boolean")


def test_best_run_of_each_list_and_shared_places(spark):
    rows = _board(spark, [(["a"], 10.0, 1, False), (["a"], 9.0, 2, False), (["b", "a"], 9.0, 3, False), (["a", "b"], 12.0, 4, False), (["c"], None, 5, False)])
    got = {tuple(r.player_ids): (r.standing, r.place, r.entries, r.timed_runs_seen, r.num_records) for r in score.board_places(rows).collect()}
    assert got == {("a",): (1, 1, 3, 4, 2), ("b", "a"): (2, 1, 3, 4, 2), ("a", "b"): (3, 3, 3, 4, 2)}


def test_boards_by_ranges_are_those_by_windows(spark, monkeypatch):
    scored = storage.staged(catalogue.normalize.scored_input(catalogue._raw(spark, SF)), "scored")
    columns = ["run_id", score.BOARD, "standing", "place", "entries", "timed_runs_seen", "num_records", "minutes", "worth"]
    found = lambda: sorted(tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in score.value_boards(scored).select(columns).collect())
    walks = lambda: sorted(map(tuple, score.record_counts(scored).collect()))
    want, counts = found(), walks()
    monkeypatch.setattr(score, "HOT_ROWS", 25)
    monkeypatch.setattr(ranking, "RANGE_ROWS", 150)
    monkeypatch.setattr(score, "RANGE_ROWS", 150)
    assert score._halves(scored)[1] is not None and found() == want and walks() == counts


def test_page_shapes_and_ord(spark):
    one = '{"leaderboard": {"runs": [{"id": "x", "time": "12.250s", "valueIds": ["v"]}, {"id": "y"}], "players": [{"id": "p", "name": " N\\t", "areaId": ""}]}}'
    two = '{"runList": [{"id": "z", "performedAt": "2001-02-03T04:05:06Z"}], "playerList": []}'
    df = spark.createDataFrame([(one, 1, 2), (two, 1, 1)], "payload string, batch int, page int").withColumn("seen_at", F.current_timestamp())
    t = payloads.parse_page_payloads(df)
    runs = {r.run_id: r for r in payloads.with_ord(t["raw_runs"], 5).collect()}
    assert {k: r.ord for k, r in runs.items()} == {"z": 5, "x": 6, "y": 7} and runs["x"].time == 12.25 and runs["y"].value_ids == [] and runs["z"].lb_type == 2
    p = t["raw_players"].first()
    assert p.name == "N" and p.area_id is None


def test_documents_of_one_file_and_absent_tables(spark, tmp_path):
    (tmp_path / "whole.json").write_text('{\n "a": [{"id": "1", "at": "2024-01-01T00:00:00"},\n {"id": "2"}]}')
    t = payloads.load_document(spark, f"file://{tmp_path}/whole.json", {"a": "id: string, at: timestamp", "b": "id: string"})
    assert [(r.id, r.at is None) for r in t["a"].collect()] == [("1", False), ("2", True)] and t["b"].count() == 0


_REQUESTS = [
    ("l=xa,!r1&g=one", "g=one&l=xa,!r1&r=pr"), ("p=low,+mid+,low", "p=low,mid&r=pr"), ("series=Blue+Sky%2CRed&request-type=dates", "s=Blue Sky,Red&r=dates"),
    ("u=Ann,ANN,!ann", "u=Ann,!ann&r=pr"), ("m=0", "r=pr&m=1"), ("limit=7&m=1000", "r=pr"), ("p=!,,", "r=pr"), ("r=runs&r=games", "r=games"), ("r=what&m=1x", "r=pr"), ("colour=red", "r=pr"), ("", "r=pr"),
]


@pytest.mark.parametrize(("query", "expected"), _REQUESTS)
def test_canonical_requests(spark, query, expected):
    terms, kind, limit, _ = resolve.parse_query(query)
    short = {v: k for k, v in resolve.KEYS.items()}
    boxes = [f"{short[b]}={','.join(s + t for x, s, t in terms if x == b)}" for b in resolve.BOXES if any(x == b for x, *_ in terms)]
    assert "&".join([*boxes, f"r={kind}", *([f"m={limit}"] if limit != 1000 else [])]) == expected
    assert resolve.canonical(spark.createDataFrame([("1", query)], "request_id string, query string")).first().canonical == expected


def test_long_lists_become_joins_with_the_same_result(spark, monkeypatch):
    t = catalogue._tables(spark, SF)
    wanted = scope.Scope(inc_games=("g1", "g2"), exc_games=("g2",), inc_platforms=("2-HIGH",), exc_platforms=("1-URGENT",), exc_players=("C10",), inc_areas=("r0/n0", "r1/n1", "r2"), exc_areas=("r1/n1",), all_scope=False, all_locations=False)
    found = lambda: sorted(map(str, requests.apply_scope(t["runs"], t["players"], wanted).collect()))
    want = found()
    monkeypatch.setattr(scope, "INLINE", 0)
    assert found() == want and want


def test_a_request_from_its_text_to_its_answer(spark):
    t, lands = catalogue._tables(spark, SF), catalogue._lands(spark)
    rows, warnings = answers.answer_query("g=game1,nothing&r=runs&m=3", t, lands)
    got = rows.collect()
    assert [r.Rank for r in got] == [1, 2, 3] and all(r.truncated for r in got) and warnings == ["Nothing found in games: nothing"]
    rows, _ = answers.answer_query("s=none+such", t, lands)
    assert rows.count() == 0
    few, _ = answers.answer_query("r=series&m=500", t, lands)
    assert not any(r.truncated for r in few.collect())


def test_gates_fail_one_by_one(spark):
    t = catalogue._tables(spark, SF)
    good = {**t, "meta": t["meta"].withColumn("errored_games", F.lit(0)).withColumn("leaderboard_count", F.lit(700_000))}
    failed = lambda new, old=None: {r.name for r in quality.run_gates(new, old, ["Customer#000000001"], "Game 1").collect() if not r.ok}
    assert failed(good) == set() and failed(good, good) == set()
    changed = lambda **c: {**good, "runs": good["runs"].withColumns(c)}
    assert failed(t) == {"enough_boards", "few_failed_games"}
    assert failed(changed(game=F.when(F.col("place") > 1, F.col("game")))) == {"keys_present"}
    assert failed(changed(place=F.lit(0))) == {"ranges_kept"}
    assert failed({**good, "runs": good["runs"].unionByName(good["runs"].limit(1))}) == {"credits_unique"}
    assert failed(changed(player=F.lit("Customer#000000001"))) == {"exclusions_kept"}
    assert failed(changed(game=F.lit("Other"))) == {"known_game_has_runs", "known_game_has_players"}
    more = {**good, "meta": good["meta"].withColumns({c: F.col(c) * 2 for c in quality.FLOORS})}
    assert failed(good, more) == {f"{c}_share" for c in quality.FLOORS}
    assert failed(good, changed(value=F.col("value") * 2)) == {"value_share"}
    others = {**good, "player_ranks": good["player_ranks"].withColumn("player_id", F.concat("player_id", F.lit("x")))}
    assert failed(good, others) == {"top_players_shared"}
    stats = quality.snapshot_stats(good, changed(value=F.col("value") * 2)).first()
    assert (stats.row_delta, stats.value_ratio) == (0, 0.5)


def test_snapshots_are_written_only_if_all_gates_pass(spark):
    t, root = catalogue._tables(spark, SF), storage.new_path(spark, "gated")
    good = {**t, "meta": t["meta"].withColumn("errored_games", F.lit(0))}
    with pytest.raises(LookupError):
        publish.read_snapshot(spark, root)
    assert publish.publish_checked(good, root, "1", [], "Game 1", 10).where("not ok").count() == 0
    assert publish.publish_checked(good, root, "2", [], "No such game", 10).where("not ok").count() == 2
    read = publish.read_snapshot(spark, root)
    assert set(read) == set(publish.NAMES) and all("version=1" in df.inputFiles()[0] for df in read.values())
    for name, df in read.items():
        assert ranking.symmetric_difference(df.drop("published_at"), good[name].drop("published_at"), distinct=False).count() == 0


def test_differences_with_and_without_numbers(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    found = lambda distinct: sorted(map(tuple, ranking.symmetric_difference(a, b, distinct).collect()))
    assert found(True) == [(2, "a"), (3, "b")] and found(False) == [(1, "a"), (2, "a"), (3, "b")]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from rankengine.streaming import ingest

    rows = lambda *x: spark.createDataFrame(x, "id long, at long, what string")
    step = lambda batch: batch.groupBy("id").agg(F.max_by("what", "at").alias("what"), F.max("at").alias("at"))
    out = f"file://{tmp_path}/out"
    for k, batch in enumerate([[(1, 5, "a"), (2, 1, "b")], [(1, 4, "late"), (2, 7, "new")]]):
        rows(*batch).write.parquet(f"file://{tmp_path}/in/{k}")
        ingest.start_ingest(spark, f"file://{tmp_path}/in/*", f"{out}/all", f"{out}/c1", "id long, at long, what string").awaitTermination()
        ingest.start_progress(spark, f"file://{tmp_path}/in/*", f"{out}/p", f"{out}/c2", "id long, at long, what string", step, "id", "at").awaitTermination()
    assert spark.read.parquet(f"{out}/all").count() == 4
    assert sorted((r.id, r.what) for r in ingest.latest_progress(spark, f"{out}/p", "id", "at").collect()) == [(1, "a"), (2, "new")]


@pytest.mark.parametrize("name", ["board_places", "runs_published", "req_pr_scoped", "req_dates", "req_games", "dims_areas", "scope_exclusions", "suggest_names", "suggest_locations", "ingest_games", "ingest_static", "ingest_lists", "continent_areas", "answered_request", "answered_log", "answered_log_states", "ingest_quarantine", "ingest_payloads", "drop_partial_stored", "drop_errored", "snapshot_diff", "stream_progress", "suggest_players", "republished_ranks"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, SF), con.sql(catalogue.oracle_sql()[name])
    columns = sorted(want.columns)
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
