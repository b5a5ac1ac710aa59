"""What keeps hot keys, many requests and small changes from becoming large work."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from rankengine.operators import ranking, storage
from rankengine.plans import answers, batch, catalogue, increment, publish, requests, resolve, scope
from rankengine.sources import payloads
from rankengine.streaming import ingest

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_of_a_player_with_half_of_all_runs(spark):
    player = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50))
    runs = spark.range(0, 20_000, 1, 16).select(player.alias("player_id"), player.alias("player"), (F.col("id") * 7919 % 10007 / 1000.0).alias("value"))
    values = {}
    for r in runs.collect():
        values.setdefault(r.player_id, []).append(r.value)
    for decay, floor in ((0.99, 0.25), (0.5, 0.25), (0.9, 0.0)):
        points = publish.player_points(runs, decay, floor)
        want = {k: sum(max(x * decay**i, x * floor) for i, x in enumerate(sorted(v, reverse=True))) for k, v in values.items()}
        got = {r.player_id: r.points for r in points.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert publish.full_places() == 138 and publish.full_places(0.9, 0.0) is None
    # each task drops what can't be among a player's best before rows are shuffled
    assert _plan(publish.player_points(runs)).count("WindowGroupLimit") == 2


def test_a_log_gets_the_answers_of_its_requests(spark, monkeypatch):
    monkeypatch.setattr(batch, "WORDS", 1)
    monkeypatch.setattr(batch, "CHUNK", 64)
    tables, lands = catalogue._tables(spark, SF), catalogue._lands(spark)
    log = catalogue._mixed_log(spark, SF)
    rows, states = batch.answer_log(log, tables, lands)
    found, state = {}, {r.request_id: r for r in states.collect()}
    for r in rows.collect():
        found.setdefault(r.request_id, []).append(r)
    queries = {r.request_id: r.query for r in log.collect()}
    assert state.keys() == queries.keys()
    for name in ("c10", "c13", "c17", "f0", "f2"):
        want, warnings = answers.answer_query(queries[name], tables, lands)
        want = sorted((r.asDict() for r in want.collect()), key=lambda r: r["Rank"])
        got = sorted(found.get(name, []), key=lambda r: r.rank)
        assert [(r.rank, r.name, r.points) for r in got] == [(w["Rank"], *[str(v) for k, v in w.items() if k in ("Leaderboard", "Game", "Series", "Date") or k == "Player" and "Leaderboard" not in w], w["Points"]) for w in want]
        assert (state[name].n_rows, state[name].truncated, sorted(state[name].warnings)) == (len(want), any(w["truncated"] for w in want), sorted(warnings))


def test_open_scopes_cost_what_their_games_have(spark, monkeypatch):
    monkeypatch.setattr(batch, "WORDS", 1)
    monkeypatch.setattr(batch, "CHUNK", 64)
    kept, staged = {}, batch.staged
    monkeypatch.setattr(batch, "staged", lambda df, name: kept.setdefault(name, staged(df, name)))
    tables, lands = catalogue._tables(spark, SF), catalogue._lands(spark)
    queries = {f"q{k}": f"g=game{k % 3},!game{k % 2 + 7}&u=!C{k}&r=records&m=5" for k in range(200)} | {f"s{k}": "s=t-1,s-2&l=!r1&r=series" for k in range(50)}
    rows, _ = batch.answer_log(spark.createDataFrame(list(queries.items()), "request_id string, query string"), tables, lands)
    assert kept["player-words"].count() == 0  # before: each player for each chunk of scopes
    assert kept["log-ids"].count() <= 200 * 3 + 50 * 3  # before: each game of a series for each request
    found = {}
    for r in rows.collect():
        found.setdefault(r.request_id, []).append((r.rank, r.name, r.points))
    for name in ("q4", "s0"):
        want = answers.answer_query(queries[name], tables, lands)[0].collect()
        assert want and sorted(found[name]) == sorted((w["Rank"], w["Leaderboard" if name == "q4" else "Series"], w["Points"]) for w in want)


def test_one_query_string_is_read_as_a_log_is(spark):
    odd = ["g=a%2,b&g=%zz", "%67=x+y&l=%E2%82%AC", "r=runs&r=", "m=+7", "m=-3&r=nope", "m=99999999999999999999", "u=!,! x,!X&s=,", "g==a=b&&p", "limit=1.5"]
    log = catalogue._mixed_log(spark, SF).unionByName(spark.createDataFrame([(f"o{i}", q) for i, q in enumerate(odd)], "request_id string, query string"))
    queries = {r.request_id: r.query for r in log.collect()}
    terms = {}
    for r in resolve.request_terms(log).orderBy("pos").collect():
        terms.setdefault(r.request_id, {}).setdefault(r.box, []).append((r.sign, r.term))
    for r in resolve.request_settings(log).collect():
        found, kind, limit, warnings = resolve.parse_query(queries[r.request_id])
        boxes = {}
        for box, sign, term in found:
            boxes.setdefault(box, []).append((sign, term))
        assert (boxes, kind, limit, warnings) == (terms.get(r.request_id, {}), r.request_type, r.limit, r.warnings), queries[r.request_id]


def test_long_lists_of_one_request_stay_tables(spark, monkeypatch):
    tables, lands = catalogue._tables(spark, SF), catalogue._lands(spark)
    queries = ["g=game1,!game2&s=t-1&l=!r0/n0,XB&r=games", "s=!s-2&p=high&u=C10,C11,C12&r=runs", "l=nation+3,r1&r=pr", "s=none&r=pr"]
    rows = lambda: [sorted(map(str, answers.answer_query(q, tables, lands)[0].collect())) for q in queries]
    want = rows()
    for module in (answers, scope):
        monkeypatch.setattr(module, "INLINE", 0)
    assert rows() == want and all(want[:3])


def test_answers_come_with_styles_and_slugs(spark):
    tables, lands = catalogue._tables(spark, SF), catalogue._lands(spark)
    rows, _ = answers.answer_query("g=game1&r=runs&m=50", tables, lands)
    styles, slugs = answers.enrichment(rows, tables)
    names = {r.Player for r in rows.collect()}
    assert {r.name for r in styles.collect()} <= names and {r.name for r in slugs.where("column = 'Player'").collect()} <= names and slugs.count()
    assert answers.enrichment(answers.answer_query("r=dates", tables, lands)[0], tables) == (None, None)


def test_every_payload_is_read_or_in_quarantine(spark):
    run = {"id": "r", "gameId": "g", "playerIds": ["p"]}
    good = [{"leaderboard": {"runs": [run], "players": []}}, {"runList": [], "playerList": []}, {"runList": [run], "later": 1}]
    bad = [("wrong type", '{"runList": {"id": 1}}'), ("wrong type", "[3]"), ("not JSON", '{"runList": [{"id"'), ("nothing needed", "{}"), ("nothing needed", '{"playerList": []}'), ("empty", None), ("empty", " ")]
    rows = [(json.dumps(x), 1, i, f"g{i}", "ok") for i, x in enumerate(good)] + [(t, 1, 50 + i, f"b{i}", why) for i, (why, t) in enumerate(bad)]
    df = spark.createDataFrame(rows, "payload string, batch int, page int, game_id string, reason_given string").withColumn("seen_at", F.current_timestamp())
    t = payloads.parse_page_payloads(df)
    assert sorted(r.run_id for r in t["raw_runs"].collect()) == ["r", "r"]
    kept = {r.game_id: r for r in t["quarantine"].collect()}
    assert {k: (r.reason, r.payload) for k, r in kept.items()} == {f"b{i}": x for i, x in enumerate(bad)}
    assert {r.game_id: (r.status, r.error) for r in payloads.errors(t["quarantine"]).collect()} == {f"b{i}": ("error", x[0]) for i, x in enumerate(bad)}
    static = payloads.parse_static_payloads(df.select("payload", "seen_at"))
    lists = payloads.parse_list_payloads(df.select("payload", "seen_at").withColumn("series_id", F.lit("s")))
    assert static["quarantine"].count() == lists["quarantine"].count() == len(rows)


def test_only_parts_with_unfinished_games_are_written_anew(spark):
    path = storage.new_path(spark, "raw-runs")
    runs = spark.range(3000).select(F.concat(F.lit("g"), F.col("id") % 200).alias("game_id"), F.col("id").alias("ord"))
    payloads.write_raw_runs(runs.where("ord < 1500"), path)
    payloads.write_raw_runs(runs.where("ord >= 1500"), path)
    status = lambda bad: spark.createDataFrame([(f"g{i}", "error" if i in bad else "done") for i in range(200)], "game_id string, status string")
    files = lambda: {(d, f): os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path.removeprefix("file://")) for f in names if "part=" in d and f.endswith(".parquet")}
    before = files()
    assert len(before) > 60 and payloads.drop_partial_rows(spark, path, status(())) == []
    touched = payloads.drop_partial_rows(spark, path, status({3, 4}))
    after, of = files(), lambda names, part: {k: v for k, v in names.items() if k[0].endswith(f"part={part}")}
    assert 1 <= len(touched) <= 2 and all(of(before, p) == of(after, p) for p in range(payloads.PARTS) if p not in touched)
    left = spark.read.parquet(path)
    assert left.count() == 2970 and left.where("game_id in ('g3', 'g4')").count() == 0
    alone = touched[0]
    rest = {int(r.game_id[1:]) for r in left.where(F.col("part") == alone).select("game_id").distinct().collect()}
    assert payloads.drop_partial_rows(spark, path, status(rest), retry_errors_only=True) == [alone] and not of(files(), alone)
    assert spark.read.parquet(path).count() == 2970 - 15 * len(rest)


def test_progress_is_read_from_the_base_however_many_batches_came(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MERGE_EVERY", 3)
    out, schema = f"file://{tmp_path}/out", "id long, at long, what string"
    step = lambda batch: batch.groupBy("id").agg(F.max_by("what", "at").alias("what"), F.max("at").alias("at"))
    want, read = {}, []
    for k in range(12):
        rows = [(i, 100 * k + i if i % 5 or k % 2 else 1, f"{k}-{i}") for i in range(k, k + 8)]
        for i, at, what in rows:
            want[i] = max(want.get(i, (-1, "")), (at, what))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        if k == 7:  # a merge that was killed before its manifest was written
            spark.range(3).write.parquet(f"{out}/base/upto=6")
        ingest.start_progress(spark, f"file://{tmp_path}/in/*", out, f"{out}/c", schema, step, "id", "at").awaitTermination()
        latest = ingest.latest_progress(spark, out, "id", "at")
        assert {r.id: (r.at, r.what) for r in latest.collect()} == want
        read.append(sum("/progress/batch=" in f for f in latest.inputFiles()))
    assert max(read[4:]) <= 2 * (ingest.MERGE_EVERY + 1) and len(ingest._names(spark, f"{out}/progress", "batch")) < 12
    ingest.merge_progress(spark, out, "id", "at", 11)
    assert {r.id: (r.at, r.what) for r in ingest.latest_progress(spark, out, "id", "at").collect()} == want


def test_differences_take_one_shuffle(spark):
    a, b = spark.range(5000).select((F.col("id") % 700).alias("x"), F.lit("y").alias("y")), spark.range(900).select("id", F.lit("y").alias("y")).toDF("x", "y")
    for distinct in (True, False):
        assert _plan(ranking.symmetric_difference(a, b, distinct)).count("Exchange hashpartitioning") == 1
    assert ranking.symmetric_difference(a, b).count() == 200 and ranking.symmetric_difference(a, b, False).count() == 200 + 5000 - 700


def test_suggestions_for_letters_that_all_names_hold(spark):
    rows = [(f"i{i}", f"The thing {i}", f"the-{i}" if i % 3 else None) for i in range(2000)] + [("z", "Etna %_", "t"), ("y", None, "thin-air")]
    table = spark.createDataFrame(rows, "id string, name string, slug string").withColumns({"name_lower": F.lower("name"), "slug_lower": F.lower("slug")})
    asked = ["t", "T", "%", "th", "e t", "thing 19", "thin-a", "the-1", "thing", "no such", " 77 ", "thin-air and more", ""]
    needles = spark.createDataFrame([(x,) for x in asked], "needle string")
    index = storage.staged(requests.name_index(table), "index")
    assert index.groupBy("gram").count().agg(F.max("count")).first()[0] == 10
    want = []
    for needle in asked:
        q = needle.strip().lower()
        fits = [(not (n or "").lower().startswith(q), not (s or "").startswith(q), len(n or ""), n or "", n, s) for _, n, s in rows if q and (n and q in n.lower() or s and s.startswith(q))]
        want += [(needle, x[4], x[5], k + 1) for k, x in enumerate(sorted(fits, key=lambda x: (x[4] is None and x[0], *x[:4]) if x[4] is not None else (True, *x[:4]))[:10])]
    for how in ({}, {"index": index}):
        got = sorted(map(str, (tuple(r) for r in requests.suggest_names(table, needles, **how).collect())))
        assert [x for x in got if "thin-air" not in x] == [x for x in sorted(map(str, want)) if "thin-air" not in x]
        assert any("thin-air" in x for x in got)


def test_reads_of_a_player_skip_row_groups(spark, monkeypatch):
    monkeypatch.setattr(publish, "NAMES", ("runs", "meta"))
    runs = spark.range(40_000).select((F.col("id") % 40).cast("string").alias("game_id"), (F.col("id") % 977).cast("int").alias("leaderboard_id"), F.xxhash64(F.col("id") % 20_000).cast("string").alias("player_id"), F.lit(1).alias("place"))
    at = lambda t: spark.range(1).select(F.lit(t).cast("timestamp").alias("published_at"))
    root = storage.new_path(spark, "versions")
    # as in large files: too many players for a dictionary, which does without a filter
    monkeypatch.setattr(publish, "FILTER_VALUES", 20_000)
    spark._jsc.hadoopConfiguration().set("parquet.dictionary.page.size", "1024")
    for version, when in (("v9", "2024-01-01"), ("v10", "2024-01-02"), ("b", "2024-01-03"), ("a", "2024-01-04")):
        publish.write_snapshot({"runs": runs.limit(0) if version != "a" else runs, "meta": at(when)}, root, version)
    spark._jsc.hadoopConfiguration().unset("parquet.dictionary.page.size")
    assert publish.versions(spark, root) == ["v9", "v10", "b", "a"]
    runs = publish.read_snapshot(spark, root)["runs"]
    without = runs.sparkSession.read.option("parquet.filter.bloom.enabled", "false").parquet(f"{root}/version=a/runs")

    def scanned(where, runs=runs):
        """Rows found, and rows that the scan handed on: those of row groups that weren't skipped."""
        df = runs.where(where)
        found = len(df.collect())
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return found, leaf.metrics().apply("numOutputRows").value()

    one = runs.first()
    assert scanned(F.col("player_id") == one["player_id"])[0] == 2
    assert scanned(F.col("player_id") == "5000x") == (0, 0)  # within the bounds
    assert scanned(F.col("player_id") == "5000x", without) == (0, 40_000)


def _same(a, b):
    """Equal tables; doubles to nine digits, as sums depend on their order."""
    doubles = [c for c, t in b.dtypes if t == "double"]
    a, b = (x.select(*[F.round(c, 9).alias(c) if c in doubles else c for c in b.columns if c != "published_at"]) for x in (a, b))
    return ranking.symmetric_difference(a, b, distinct=False).count() == 0


def test_publishing_again_gives_what_publishing_gives(spark):
    raw = catalogue._raw(spark, SF)
    n = raw["raw_runs"].agg(F.max("ord")).first()[0]
    some = raw["raw_players"].where("id in ('C10', 'C11')").select("id")
    start = raw | {
        "raw_runs": raw["raw_runs"].where(F.col("ord") <= n - 60), "raw_categories": raw["raw_categories"].where("id <> 'g3-A'"), "raw_players": raw["raw_players"].join(some, "id", "left_anti"),
        "crawl_checkpoint": raw["crawl_checkpoint"].withColumn("status", F.when(F.col("game_id") == "g5", "error").otherwise(F.col("status"))),
    }
    want, _ = increment.publish_whole(raw)
    root = storage.new_path(spark, "before")
    tables, state = increment.publish_whole(start)
    publish.write_snapshot(tables, root, "1")
    increment.write_state(state, root, "1")
    again, state = increment.publish_again(raw, publish.read_snapshot(spark, root), increment.read_state(spark, root, "1"))
    assert all(_same(again[name], want[name]) for name in publish.NAMES)
    assert state["scored"].count() == want["meta"].first()["raw_run_count"]
    for other in (raw | {"raw_games": raw["raw_games"].withColumn("name", F.concat("name", F.lit("?")))}, raw | {"raw_levels": raw["raw_levels"].where("id <> 'LA'")}, start):
        assert increment._late(increment._digests(raw), increment._digests(other))[0]  # changed or gone: all is published anew


def test_a_week_is_published_once_and_only_from_a_finished_crawl(spark, monkeypatch):
    raw, root = catalogue._raw(spark, SF), storage.new_path(spark, "weekly")
    stage = lambda x: raw | {"crawl_meta": spark.createDataFrame([("version", x), ("stage", x)], "key string, value string")}
    for unfinished in (stage("games_listed"), raw | {"crawl_meta": raw["crawl_meta"].limit(0)}):
        with pytest.raises(publish.UnfinishedCrawl):
            publish.weekly(unfinished, root, [], "Game 1", 10)
    assert publish.snapshot_age(spark, root, datetime.datetime.now()) is None
    good, tables = raw, catalogue._tables(spark, SF)
    made = tables | {"meta": tables["meta"].withColumn("errored_games", F.lit(0))}
    monkeypatch.setattr(publish, "publish", lambda raw, version, at: made | {"meta": made["meta"].withColumns({"data_version": F.lit(version), "scraped_at": F.lit(at).cast("timestamp")})})
    assert publish.weekly(good, root, [], "Game 1", 10).where("not ok").count() == 0 and publish.versions(spark, root) == ["v1"]
    at = datetime.datetime(2024, 1, 10, tzinfo=datetime.UTC)
    assert publish.snapshot_age(spark, root, at) == 2 and publish.weekly(good, root, [], "Game 1", 10, now=at) is None
    meta = publish.read_snapshot(spark, root)["meta"].first()
    assert (meta.data_version, str(meta.scraped_at), meta.errored_games) == ("v1", "2024-01-08 00:00:00", 0)
    assert publish.weekly(good, root, [], "No such game", 10, force=True, now=at).where("not ok").count() == 2
    assert publish.weekly(good, root, [], "No such game", 10, now=at + datetime.timedelta(days=9)).where("not ok").count() == 2


def test_long_needles_are_sent_to_the_names_and_not_the_names_to_them(spark):
    id_ = F.col("id").cast("string")
    names = spark.range(2000).select(id_.alias("id"), F.concat(F.lit("Player#"), id_).alias("name"), id_.alias("slug"), F.concat(F.lit("player#"), id_).alias("name_lower"), id_.alias("slug_lower"))
    table = storage.staged(names, "names")
    found = requests.suggest_names(table, spark.createDataFrame([("er#19",), ("1999",)], "needle string"), index=storage.staged(requests.name_index(table), "names-index"))
    assert "BuildLeft" not in _plan(found).split("Union")[-1]
    got = {(r.needle, r.nth): r.name for r in found.collect()}
    assert got[("er#19", 1)] == "Player#19" and got[("1999", 1)] == "Player#1999" and len(got) == 11


def test_a_scope_of_many_players_and_all_games(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(requests, "player_rankings", lambda tables, scope: asked.setdefault("scope", scope))
    ids = spark.range(2000).select(F.concat(F.lit("g"), "id").alias("id"))
    monkeypatch.setattr(catalogue, "_tables", lambda s, d: {"games": ids})
    catalogue.req_pr_many_players(spark, SF)
    runs = ids.select(F.col("id").alias("game_id"), F.lit(None).cast("string").alias("platform_id"), F.lit("C7").alias("player_id"))
    players = spark.createDataFrame([("C7", None)], "id string, area_id string")
    assert scope.apply_scope(runs, players, asked["scope"]).count() == 2000


def test_numbers_by_groups_of_a_key_and_raw_runs_written_once(spark):
    rows = spark.range(0, 500, 1, 4).select((F.col("id") * 7919 % 97).alias("k"), (F.col("id") * 31 % 499).alias("x"))
    got = sorted((r.n, r.k, r.x) for r in ranking.grouped_row_number(rows, "k", [F.col("x").asc()], "n").collect())
    assert got == [(i + 1, k, x) for i, (k, x) in enumerate(sorted((r.k, r.x) for r in rows.collect()))]
    plan = _plan(catalogue._raw(spark, SF)["raw_runs"])
    assert "Scan parquet" in plan and "Join" not in plan
