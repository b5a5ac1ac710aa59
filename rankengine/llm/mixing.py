"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Sources (by code point, null last) weigh 3, 1, 2, repeating. They share `share` times all words; a target stops at
`repeat` times its source's size, and what that leaves over is shared again by weight until no target is above.

Each source's documents, in shuffled order, form a stream of words that starts anew when it ends. Slot t of the schedule
is put at the van der Corput point of t (its bits mirrored), which falls into one source's part of [0, 1); the k-th slot
of a source takes its k-th block of `block` words. A source whose slots reach beyond its target has the last ones cut;
one whose slots fall short gets closing slots (without a number) at the end, so every source gives exactly its target,
rounded down. `mix` tells how many words each document gives and its first and last slot; `mix_blocks` lists the blocks
in the order of their slots, with the part of each document in them.

Everything is DataFrame operations: positions are running sums in two levels (within hash buckets of a source, and over
the buckets), ranks of slots likewise (within runs of slots, and over the runs), so no source lands in one task. Sources
are ranked and their targets found by running sums over ranges of sources, so many sources (hosts) aren't one task either.

Null and empty texts have size 0 and are taken 0 times. Repeated rows of a document, and rows with a null id, are separate
documents of the same id, ordered by their text; identical rows have places of their own in the stream, so the results of
all of them don't depend on which is which. Extra columns are dropped. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import running
from . import staging

#: Fixed values of the contract.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
REPEAT = 2
#: Slots that the schedule is cut into at least and at most about; blocks are as long as that makes them.
SLOTS = 1 << 20
LEAST_BLOCK = 16
BITS = 40
#: Hexadecimal digits of the shuffling key that make a bucket.
BUCKET_DIGITS = 3
RUN = 4096
BINS = 4096


def words_in(text: str = "text") -> Column:
    """Words of a text: runs without ASCII white space."""
    n = F.size(F.filter(F.split(F.col(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    return F.coalesce(F.when(F.col(text).isNull(), 0).otherwise(n), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffling key of each row; texts are read here only."""
    return docs.select("doc_id", "source", words_in().alias("size"), shuffle_key().alias("key"))


def shuffle_key() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit(""))))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target: one row for each source."""
    by = staging.staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    by = running(by, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * REPEAT)
    by = by.withColumn("ratio", F.col("cap") / F.col("weight"))
    # sources that reach their cap first come first; each is capped if the level that its predecessors leave is above it
    by = running(by, [F.col("ratio").asc(), F.col("rank").asc()], {"gone": F.col("cap"), "used": F.col("weight")})
    whole = by.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    level = (F.lit((whole["total"] or 0) * SHARE_PERCENT / 100.0) - F.col("gone")) / (F.lit(whole["weights"] or 0).cast("long") - F.col("used"))
    by = by.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    free = by.where("not capped").agg(F.min(F.struct("ratio", "level")).alias("x")).first()["x"]
    free = F.lit(free["level"] if free else 0.0)
    return by.select("source", "rank", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * free).alias("target"))


def van_der_corput(t: Column, bits: int = BITS) -> Column:
    """The bits of t mirrored behind the point."""
    total = F.lit(0.0)
    for i in range(bits):
        total = total + F.shiftright(t, i).bitwiseAND(F.lit(1)) * F.lit(2.0 ** -(i + 1))
    return total


def schedule(goals: DataFrame, block: int, slots: int) -> DataFrame:
    """source, slot (null for closing slots), rank, low, high: the words of the source's endless stream that a slot takes.

    Cumulative shares are cut into BINS; slots find their source by an equi-join on the bin.
    """
    spark = goals.sparkSession
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    some = goals.where("target > 0")
    last = some.agg(F.max("rank")).first()[0]
    parts = running(some, [F.col("rank").asc()], {"below": F.col("target")}).withColumn("from", F.col("below") / F.lit(total or 1.0))
    upto = (F.col("below") + F.col("target")) / F.lit(total or 1.0)
    # neighbours meet where the next one begins, as it computes that
    parts = parts.withColumn("to", F.when(F.col("rank") == F.lit(last), F.lit(2.0)).otherwise(upto))
    bins = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") * BINS).cast("int"), F.least(F.floor(F.col("to") * BINS), F.lit(BINS - 1)).cast("int"))))
    points = spark.range(slots).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("u"))
    points = points.withColumn("bin", F.floor(F.col("u") * BINS).cast("int"))
    placed = points.join(bins.select("bin", "source", "from", "to"), "bin").where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to")))
    # rank of a slot in its source: slots of earlier runs, and earlier slots of its run
    placed = placed.select("slot", F.struct("source").alias("s"), F.floor(F.col("slot") / RUN).alias("run"))
    inner = F.row_number().over(Window.partitionBy("s", "run").orderBy("slot")) - 1
    runs = placed.groupBy("s", "run").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("inner", inner).join(runs.withColumn("offset", offset).select("s", "run", "offset"), ["s", "run"])
    ranked = ranked.select("s", "slot", (F.col("offset") + F.col("inner")).alias("rank"))
    took = runs.groupBy("s").agg(F.sum("n").alias("n"))
    limits = goals.select(F.struct("source").alias("s"), F.floor("target").cast("long").alias("limit"))
    limits = limits.join(took, "s", "left").select("s", "limit", F.coalesce("n", F.lit(0)).alias("n"))
    blocks = F.ceil(F.col("limit") / block)
    closing = limits.where(F.col("n") < blocks).select("s", F.lit(None).cast("long").alias("slot"), F.explode(F.sequence(F.col("n"), blocks - 1)).alias("rank"))
    taken = ranked.unionByName(closing).join(limits.select("s", "limit"), "s").where(F.col("rank") * block < F.col("limit"))
    low = F.col("rank") * block
    return taken.select(F.col("s.source").alias("source"), "slot", "rank", low.alias("low"), F.least(low + block, F.col("limit")).alias("high"))


def positions(sizes: DataFrame) -> DataFrame:
    """sizes with `at`: the words before the document in its source's shuffled stream."""
    rows = sizes.withColumn("s", F.struct("source")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.withColumn("inner", inner).join(sums.withColumn("base", base).select("s", "bucket", "base"), ["s", "bucket"])
    return at.select("doc_id", "source", "size", "key", (F.col("base") + F.col("inner")).alias("at"))


def _planned(docs: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their place in the stream of their source, and (s, at, rank, slot, low, high): the parts of rows with
    words that blocks take, as words of the endless stream."""
    sizes = staging.staged(sized(docs), "mix-sizes")
    goals = staging.staged(targets(sizes), "mix-targets")
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    block = max(LEAST_BLOCK, int(total) // slots + 1)
    plan = schedule(goals, block, int(total) // block + 1)
    whole = goals.select(F.struct("source").alias("s"), "source_size", "target")
    rows = positions(sizes).withColumn("s", F.struct("source")).join(F.broadcast(whole) if goals.count() < 10_000 else whole, "s")
    # each pass of a document over the blocks that it lies in; `at` tells rows with words of a source apart
    passes = rows.where("size > 0").select("s", "at", "size", F.explode(F.transform(F.array(*[F.lit(i) for i in range(REPEAT)]), lambda p: F.col("at") + p * F.col("source_size"))).alias("low"))
    passes = passes.select("s", "at", "low", (F.col("low") + F.col("size")).alias("high"))
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    slots_ = plan.select(F.struct("source").alias("s"), "rank", "slot", F.col("low").alias("a"), F.col("high").alias("b"))
    hits = pieces.join(slots_, ["s", "rank"]).select("s", "at", "rank", "slot", F.greatest("low", "a").alias("low"), F.least("high", "b").alias("high"))
    return rows, hits.where("low < high")


def mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, key, size, source_size, target, taken (words of the row that the mix takes, repeats counted),
    first_slot, last_slot (null, if only closing slots or none take any)."""
    rows, hits = _planned(docs, slots)
    taken = hits.groupBy("s", "at").agg(F.sum(F.col("high") - F.col("low")).alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    # rows without words share places with others
    taken = taken.select("s", "at", F.lit(True).alias("some"), "n", "first_slot", "last_slot")
    out = rows.withColumn("some", F.col("size") > 0).join(taken, ["s", "at", "some"], "left")
    return out.select("doc_id", "source", "key", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot")


def mix_blocks(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The mix itself: slot (null for closing slots, which come last), source, rank (the block's number in its source),
    doc_id, key, pass (0: first reading), first and end (words of the document). In order of slot, rank and pass and first."""
    rows, hits = _planned(docs, slots)
    parts = hits.join(rows.where("size > 0").select("s", "at", "doc_id", "key", "source_size"), ["s", "at"])
    again = F.floor(F.col("low") / F.col("source_size"))
    begin = F.col("at") + again * F.col("source_size")
    return parts.select("slot", F.col("s.source").alias("source"), "rank", "doc_id", "key", again.cast("int").alias("pass"), (F.col("low") - begin).alias("first"), (F.col("high") - begin).alias("end"))
