"""Hard negatives, periodic runs and edit fingerprints against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankengine.llm import edit_prints, hard_negatives, period_runs, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, start long, key string, part int, role int, fingerprint int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 0, 1, 2, "k", 1, 1, 0) for i, t in rows], SCHEMA)


# -- hard negatives --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 17, 50), (130, 64, 301), (64, 64, 64)])
def test_strassen_is_exact(monkeypatch, shape):
    monkeypatch.setattr(hard_negatives, "SMALL", 0)
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(1 << 27), 1 << 27, shape[:2]), rng.integers(-(1 << 27), 1 << 27, shape[1:])
    assert (hard_negatives.strassen(a, b, 2) == a @ b).all()


def _mined(rows, positives=5, negatives=5):
    """Rows are (vec_id, label, components)."""
    last = 1 << 70
    out = []
    for i, (vec, label, q) in enumerate(rows):
        if vec is None or vec % 100:
            continue
        found = [(-sum(x * y for x, y in zip(q, other, strict=False)), last if v is None else v, kind) for j, (v, kind, other) in enumerate(rows) if j != i]
        for s, v, _ in sorted(x for x in found if x[2] == label)[:positives]:
            fits = sorted(x for x in found if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(vec, None if v == last else v, k + 1, None if w == last else w, -s, -t) for k, (t, w, _) in enumerate(fits)]
    return sorted(map(str, out))


def _random_rows(rng):
    rows = [(i if i % 17 else i - i % 100, rng.randrange(3), [rng.randrange(-5, 60) for _ in range(5)]) for i in range(700)]
    rows += [(900, 1, [50] * 5), (900, 1, [50] * 5), (901, 2, [50] * 5), (None, 2, [50] * 5), (None, 1, [49] * 5), (902, 2, []), (1000, 0, [1, 2]), (1100, 9, [3] * 5)]
    return rows + [(2000 + i, 2, [40] * 5) for i in range(60)]


def test_hard_negatives_with_ties_repeated_rows_and_blocks(spark, monkeypatch):
    rows = _random_rows(random.Random(4))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, q array<long>, n int, rank int").repartition(3)
    got = lambda: sorted(str(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())
    want = _mined(rows)
    assert len(want) > 100 and got() == want
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 5 * 8 * 30)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "WORK", 20_000)
    assert got() == want


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0]), (1, None, [1.0]), (2, 1, None), (3, 1, [None]), (4, 1, [nan]), (5, 1, [-inf]), (6, 1, [-0.001, 0.999]), (7, 2, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert {r.vec_id: r.q for r in hard_negatives.quantised(df).collect()} == {0: [256], 6: [-1, 255], 7: []}
    assert hard_negatives.mine(hard_negatives.quantised(df.where("vec_id is null")), F.lit(True)).count() == 0


def test_hard_negatives_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op11_hard_negatives"])
    got = queries.op11_hard_negatives(spark, SF)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall()) and got.count()


# -- periodic runs ---------------------------------------------------------------------------------------------------


def _runs(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            begin = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - begin >= 3 * q:
                found.add((begin, i - begin + q, q))
            i += 1
    return sorted((x for x in found if not any(y[2] < x[2] and y[0] <= x[0] and y[0] + y[1] >= x[0] + x[1] for y in found)), key=lambda x: (x[0], x[2]))


def _words(rng):
    kind, n = rng.randrange(5), rng.randrange(120)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return ([rng.randrange(2) for _ in range(rng.randrange(1, 20))] * 120)[:n]
    if kind == 2:
        return [x for _ in range(9) for x in [rng.randrange(3) for _ in range(rng.randrange(1, 8))] * rng.randrange(1, 9)]
    if kind == 3:
        return (([0] * rng.randrange(1, 30) + [1]) * 30)[: rng.randrange(1, 200)]
    w = [0]
    while len(w) < 200:
        w = w * rng.randrange(1, 6) + [rng.randrange(2)]
    return w


def test_runs_however_words_are_appended():
    rng = random.Random(9)
    for _ in range(400):
        w = np.array(_words(rng), np.int64)
        want = _runs(w.tolist())
        assert [tuple(x) for x in period_runs.find_runs(w).tolist()] == want
        online, at = period_runs.Catchers(), 0
        while at == 0 or at < len(w):
            step = rng.choice([1, 1, 2, 3, 7, 20, 64])
            online.append(w[at : at + step], last=at + step >= len(w))
            at += step
        assert [tuple(x) for x in online.runs().tolist()] == want and online.sound()


def test_squares_are_reported_while_words_come():
    online, seen = period_runs.Catchers(), []
    for i in range(40):
        online.append(np.array([i % 3 if i < 30 else 100 + i]))
        seen.append(len(online.runs()))
    assert seen[10] == 0 and seen[11] == 1 and online.runs().tolist() == [[0, 30, 3]]


def test_documents_without_what_repeats(spark):
    texts = [None, "", " \n", "one", "a " * 5, "a " * 6, "x " + "b c " * 9 + "d", "Ä ö\t" * 4, "p q r s " * 8 + "t u " * 7 + "u " * 6, ("k " * 9 + "l ") * 5, "m n o " * 300_000, "e f " * 5, "e f " * 5]
    docs = table(spark, [*[(i, t) for i, t in enumerate(texts)], (None, "a b " * 5), (7, "dup"), *[(i, f"w{i} " * 3 + "some other words of a text that go on for long " * 2) for i in range(100, 140)]])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for plant in (False, True):
        got = sorted(tuple(r) for r in period_runs.collapse_runs(docs, plant=plant).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed").na.fill({"doc_id": -1}).collect())
        want = []
        for r in docs.collect():
            w = WORD.findall(r.text or "")
            h = zlib.crc32(str(r.doc_id).encode())
            if plant and r.doc_id is not None and h % 10 == 0 and w:
                g = h // 10
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
            runs = [x for x in (_runs(w) if len(w) < 2000 else [(0, len(w), 3)]) if x[1] >= max(6, 4 * x[2])]
            best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            kept = " ".join(x for i, x in enumerate(w) if i not in gone)
            want.append((-1 if r.doc_id is None else r.doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept), kept))
        assert got == sorted(want)
    assert period_runs.collapse_runs(table(spark, [])).count() == 0


# -- edit fingerprints -----------------------------------------------------------------------------------------------


def _mutated(rng, text, edits):
    x = list(text)
    for _ in range(edits):
        i = rng.randrange(len(x))
        x[i : i + rng.randrange(2)] = rng.choice(["", "q", "zz"])
    return "".join(x)


def _plain_walk(text, start):
    """Places behind each character, one step at a time."""
    place, out = start, []
    for ch in np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64):
        kind = int(period_runs.mix(np.array([ch], np.uint64) + edit_prints._SEED)[0] >> np.uint64(59))
        place += (edit_prints._next_places()[kind * edit_prints.CYCLE + place % edit_prints.CYCLE] - place % edit_prints.CYCLE - 1) % edit_prints.CYCLE + 1
        out.append(int(place))
    return out


def test_walks_side_by_side_and_alone(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé 字") for _ in range(rng.randrange(90))) for _ in range(60)] + ["", "x"]
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
    starts = [rng.randrange(1, 2000) for _ in texts]
    want = [_plain_walk(t, s) for t, s in zip(texts, starts, strict=True)]
    for least in (1, 10, 1000):
        monkeypatch.setattr(edit_prints, "SIDE_BY_SIDE", least)
        assert [x.tolist() for x in edit_prints._walks(codes, starts)] == want


def test_likeness_falls_with_edits():
    rng = random.Random(6)
    texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(3000)) for _ in range(40)]
    prints = edit_prints._prints(texts)
    def alike(others):
        return np.median(edit_prints.likeness((np.array([p.last for p in prints]), np.array([p.last for p in others])), ([p.strata for p in prints], [p.strata for p in others])))
    near = [alike(edit_prints._prints([_mutated(rng, t, k) for t in texts])) for k in (0, 3, 30, 300)]
    assert near[0] == 1 and near[1] > 0.95 and near[1] > near[2] > near[3] and alike(prints[1:] + prints[:1]) < 0.3


def _fingerprint_rows(spark, rows):
    return edit_prints.fingerprints(table(spark, rows).repartition(3))


def test_fingerprints_of_documents_and_their_edits(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate([None, "", "a", "ab", "abc", "Ünïcödé 字 wörds", "same text " * 30, "same text " * 30, "x" * 5000, "y" * 3])]
    rows += [(20 + i, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(1500)))) for i in range(50)] + [(None, "no id"), (99, "long " * 30_000)]
    for size in (32 << 20, 700):
        monkeypatch.setattr(edit_prints, "RANGE_BYTES", size)
        got = {r.doc_id: r for r in _fingerprint_rows(spark, rows).collect()}
        assert len(got) == len(rows)
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        for (i, t), (j, u) in zip(order, order[1:] + order[:1], strict=True):
            t, u, r = t or "", u or "", got[i]
            half = len(t) // 2
            edited = t[: len(t) - half] + u[:half]
            p, q, e = edit_prints._prints([t, u, edited])
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), edit_prints._text(p), edit_prints._text(e))
            alike = lambda a, b: edit_prints.likeness((np.array([a.last]), np.array([b.last])), ([a.strata], [b.strata]))[0]
            assert (r.near_edited, r.near_next) == (alike(p, e), alike(p, q))
            if len(t) > 300 and i not in (6, 7, 8):
                assert r.near_edited > 0.25 and r.near_edited > r.near_next
    assert got[6].fingerprint == got[7].fingerprint and got[6].near_next == 1 and got[0].fingerprint == got[1].fingerprint
    assert _fingerprint_rows(spark, []).count() == 0
    one = _fingerprint_rows(spark, [(5, "abcdef")]).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1


def test_groups_of_near_texts(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("etaoin shrdlu") for _ in range(n)) for n in (60, 300, 1000, 2040, 4000, 9000) for _ in range(6)]
    rows, of = [], {}
    for g, base in enumerate(bases):
        for k in (0, 0, 1, 2):
            of[len(rows) * 3] = g
            rows.append((len(rows) * 3, _mutated(rng, base, k) if k else base))
    rows += [(9001, None), (9002, "")]
    prints = _fingerprint_rows(spark, rows)
    groups = {r.fingerprint: r.group_id for r in edit_prints.near_groups(prints).collect()}
    got = {r.doc_id: groups.get(r.fingerprint) for r in prints.collect()}
    assert got[9001] is None and got[9002] is None
    assert all(of[got[i]] == g for i, g in of.items())  # nothing of another group
    firsts = {}
    for i, g in sorted(of.items()):
        firsts.setdefault(g, i)
    base = {g: edit_prints._prints([dict(rows)[i]])[0] for g, i in firsts.items()}
    alike = lambda i: edit_prints.likeness((np.array([base[of[i]].last]), np.array([(p := edit_prints._prints([dict(rows)[i]])[0]).last])), ([base[of[i]].strata], [p.strata]))[0]
    near = [i for i in of if alike(i) >= 0.9]
    assert len(near) > 0.8 * len(of) and sum(got[i] != firsts[of[i]] for i in near) <= 0.03 * len(near)
    assert all(got[i] == got[i + 3] for i in of if i % 12 == 0)  # copies
