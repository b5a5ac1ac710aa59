"""Row choice and numbering: latest and first per key, global numbers without a one-partition window, top n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged

#: Rows that a range of a global numbering holds about.
RANGE_ROWS = 1 << 19


def latest_per_key(df: DataFrame, key: str | list[str], order: str = "seen_at") -> DataFrame:
    """One row for each key: the one with the greatest `order`; ties go to the greatest row. Partial aggregates, no sort."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(F.col(order), *[F.col(c) for c in rest if c != order])
    best = df.groupBy(*keys).agg(F.max(ranked).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _ranges(df: DataFrame, rows: int | None) -> int:
    return max(1, (df.count() if rows is None else rows) // RANGE_ROWS + 1)


def global_row_number(df: DataFrame, order: list[Column], out: str, rows: int | None = None) -> DataFrame:
    """Numbers all rows from 1 in `order`; `rows`: about how many there are, counted if not given.

    Rows are dealt to sorted ranges by the whole order, as many as the rows need, and written once with their place in
    the range; the rows of earlier ranges come on top. Where the cuts fall changes the balance, never the result.
    """
    place = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    ranged = staged(df.repartitionByRange(_ranges(df, rows), *order).sortWithinPartitions(*order).withColumn("_place", place), "numbered")
    at = F.shiftright("_place", 33).alias("_range")
    sizes = ranged.groupBy(at).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_range", before.alias("_before")))  # a row for each RANGE_ROWS rows
    numbered = ranged.withColumn("_range", at).join(offsets, "_range")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(out, F.col("_before") + inside + 1).select(*df.columns, out)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each of `sums`, its total over all rows before this one in `order`; over ranges, as above."""
    named = df.withColumns({f"_{name}": c for name, c in sums.items()})
    ranged = staged(named.repartitionByRange(_ranges(df, None), *order).withColumn("_range", F.spark_partition_id()), "running")
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_{name}").alias(f"_all_{name}") for name in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(totals.select("_range", *[F.sum(f"_all_{name}").over(earlier).alias(f"_all_{name}") for name in sums]))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select(*df.columns, "_range", *[F.sum(f"_{name}").over(inside).alias(f"_{name}") for name in sums]).join(offsets, "_range")
    return rows.select(*df.columns, *[(F.coalesce(f"_all_{name}", F.lit(0)) + F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in sums])


def grouped_row_number(df: DataFrame, key: str, order: list[Column], out: str) -> DataFrame:
    """Numbers the rows whose `key` isn't null from 1, in the order of `key` and then of `order`, where no key has more rows
    than a task takes. Rows cross the network once, by key; only keys with their numbers of rows are sorted over ranges."""
    sizes = staged(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_size")), "group-sizes")
    before = running(sizes, [F.col(key).asc()], {"_before": F.col("_size")}).select(key, "_before")
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed.join(before, key).withColumn(out, F.col("_before") + F.col("_place")).select(*df.columns, out)


def dense_ids(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds the dense rank of `name` among all its values."""
    # written, so that the join knows its size
    return df.join(staged(global_row_number(df.select(name).distinct(), [F.col(name).asc()], out), "ids"), name)


def top_n(df: DataFrame, order: list[Column], n: int, out: str = "Rank") -> DataFrame:
    """The first n rows, numbered: a limit first, so that no global window sees more than n rows."""
    return df.orderBy(*order).limit(n).withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))


def symmetric_difference(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    """Rows of one side only, with the side; as sets, or with their numbers. Both sides are summed together, row by row,
    so there is one shuffle, of partial sums."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counts = both.groupBy(*columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    side = F.when(F.col("_a") > F.col("_b"), "a").otherwise("b")
    if distinct:
        return counts.where((F.col("_a") > 0) != (F.col("_b") > 0)).select(*columns, side.alias("side"))
    more = F.abs(F.col("_a") - F.col("_b"))
    return counts.where(F.col("_a") != F.col("_b")).select(*columns, side.alias("side"), F.explode(F.sequence(F.lit(1), more)).alias("_n")).drop("_n")
