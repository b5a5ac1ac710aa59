import pytest
from pyspark.sql import functions as F

from rankengine.llm import fixity, staging

SCHEMA = "page_id long, url string, html string, hash string, node long, bytes long, name string"


def _rows(spark, rows):
    return spark.createDataFrame([(p, u, h, x, 1, 2, "n") for p, u, h, x in rows], SCHEMA)


def test_differences_are_found(spark):
    rows = [(i, f"u{i}", None if i % 5 == 0 else f"h{i}", "x") for i in range(300)] + [(7, "u7", "again", "x"), (None, None, "", "x")]
    a = _rows(spark, rows)
    b = _rows(spark, [(p, u, "" if p == 10 else h, "y") for p, u, h, _ in rows if p != 20] + [(900, "new", "new", "y")])
    got = {r.page_id: (r.status, r.offset, r.bytes) for r in fixity.audit(a, b, "page_id", ["url", "html"]).collect()}
    size = lambda p: sum(len(x or "") for q, *fields, _ in rows if q == p for x in fields)
    start = lambda p: sum(size(q) for q in range(p))
    assert got == {10: ("corrupt", start(10), size(10)), 20: ("missing", start(20), size(20)), 900: ("extra", None, None)}
    assert fixity.audit(a, a, "page_id", ["url", "html"]).count() == 0
    none = a.limit(0)
    assert fixity.audit(none, none, "page_id", ["url", "html"]).count() == 0 and fixity.audit(none, a, "page_id", ["url", "html"]).where("status = 'extra'").count() == 301


def test_odd_keys(spark, monkeypatch):
    monkeypatch.setattr(fixity, "BITS", 30)  # fewer levels
    # negative ones, such as differ by one above 2 ** 53, null beside -1 and 0, and a key of many equal and other rows
    keys = [-(1 << 40), -1, None, 0, (1 << 60), (1 << 60) + 1, (1 << 60) + 2]
    rows = [(k, "u", f"h{k}", "x") for k in keys] + [(5, "u", "same", "x")] * 50 + [(5, "u", f"v{i}", "x") for i in range(50)]
    a = _rows(spark, rows)
    for changed in [-1, None, (1 << 60) + 1, 5]:
        at = next(i for i, r in enumerate(rows) if r[0] == changed)
        b = _rows(spark, [(p, u, "other" if i == at else h, x) for i, (p, u, h, x) in enumerate(rows)][::-1])
        assert [(r.page_id, r.status) for r in fixity.audit(a, b, "page_id", ["url", "html"]).collect()] == [(changed, "corrupt")]
    # one copy less, and keys that aren't numbers
    assert [r.status for r in fixity.audit(a, _rows(spark, rows[:-51] + rows[-50:]), "page_id", ["url", "html"]).collect()] == ["corrupt"]
    named = a.withColumn("page_id", F.concat(F.lit("k"), F.col("page_id").cast("string")))
    assert [(r.page_id, r.status) for r in fixity.audit(named, named.where("page_id <> 'k-1'"), "page_id", ["url", "html"]).collect() if r.page_id] == [("k-1", "missing")]


def test_stored_trees(spark):
    a = _rows(spark, [(i, f"u{i}", "h", "x") for i in range(40)])
    b = a.withColumn("html", F.when(F.col("page_id") == 33, "other").otherwise(F.col("html")))
    paths = [staging.new_path(spark, "tree") for _ in range(2)]
    for df, path in zip((a, b.unionByName(_rows(spark, [(5000, "u", "h", "x")])), ), paths, strict=True):
        fixity.build_tree(df, "page_id", ["url", "html"], path)
    one, two = (fixity.load_tree(spark, p) for p in paths)
    assert len(one.levels) < len(two.levels)
    assert {(r.page_id, r.status) for r in fixity.compare(one, two, "page_id").collect()} == {(33, "corrupt"), (5000, "extra")}


def test_released_folders_are_gone(spark):
    since = staging.mark(spark)
    kept, gone = staging.staged(spark.range(3).toDF("a"), "kept"), staging.staged(spark.range(3).toDF("a"), "gone")
    staging.release(spark, since, (kept.inputFiles()[0].rsplit("/", 1)[0],))
    assert staging.mark(spark) - since in (0, 1)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(gone.inputFiles()[0]).count()
