"""Merkle fixity audit of a replica: trees over ordered offset ranges of records, compared from the root down.

A record's offset is its integer key (records in any other kind of key are placed by the key's 64-bit hash). A leaf holds
the records of one offset: their number, bytes and the sum of their SHA-256 hashes, limb by limb, which doesn't depend on
their order and adds up in partial aggregates, so an offset that holds a third of all rows is no single task's work. A
node of level k covers a range of FAN**k offsets and hashes its children in order, so it has at most FAN of them; the root
hashes the topmost ranges (negative ones, others, and records without a key). Trees are written out, so a second audit
reads stored levels. Two trees are compared at the root, then only below nodes whose hashes differ, down to the leaves.

Null fields are told from empty ones. Records with a null key form a range of their own. Ties: records of one key are
judged together. Extra columns are ignored. Empty tables have no ranges: everything in the other one is then missing or
extra; two empty tables don't differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import staging

BITS = 4
FAN = 1 << BITS
_LIMBS = 8
_AT = ["keyless", "node"]
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass
class Tree:
    """levels[0]: keyless, node, name (the key), hash, n, bytes; levels[k]: keyless, node, hash, n, bytes."""

    levels: list[DataFrame]

    def lifted(self, top: int) -> list[DataFrame]:
        """The levels with ranges up to FAN**top offsets, for a comparison with a taller tree."""
        out = list(self.levels)
        while len(out) <= top:
            out.append(_above(out[-1]))
        return out


def _offset(records: DataFrame, key: str) -> Column:
    integer = records.schema[key].dataType.simpleString() in _INTEGERS
    return F.col(key).cast("long") if integer else F.xxhash64(F.col(key))


def _leaves(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    texts = [F.col(c).cast("string") for c in fields]
    parts = [F.coalesce(F.concat(F.lit("="), F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts]
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)).cast("long") for t in texts), F.lit(0).cast("long"))
    rows = records.select(F.col(key).isNull().alias("keyless"), F.when(F.col(key).isNull(), F.lit(0).cast("long")).otherwise(_offset(records, key)).alias("node"), F.col(key).alias("name"), F.sha2(F.concat(*parts), 256).alias("h"), size.alias("bytes"))
    limbs = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).cast("string") for i in range(_LIMBS)]
    return rows.groupBy(*_AT).agg(F.min("name").alias("name"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *limbs), 256).alias("hash"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def _above(level: DataFrame) -> DataFrame:
    child = F.array_sort(F.collect_list(F.struct("node", "hash")))  # FAN at most
    text = F.array_join(F.transform(child, lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"])), ",")
    up = level.withColumn("node", F.col("node")).groupBy("keyless", F.shiftright("node", BITS).alias("above"))
    return up.agg(F.sha2(text, 256).alias("hash"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumnRenamed("above", "node")


def build_tree(records: DataFrame, key: str, fields: list[str], path: str | None = None) -> Tree:
    """The tree of `records`, each level written under `path` (a new folder of the session, if None)."""
    spark = records.sparkSession
    path = path or staging.new_path(spark, "fixity")

    def kept(df: DataFrame, k: int) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{path}/level={k:02}")
        return spark.read.schema(df.schema).parquet(f"{path}/level={k:02}")

    levels = [kept(_leaves(records, key, fields), 0)]
    ends = levels[0].agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
    low, high = ends["a"] or 0, ends["b"] or 0
    while low < -1 or high > 0:
        levels.append(kept(_above(levels[-1]), len(levels)))
        low, high = low >> BITS, high >> BITS
    return Tree(levels)


def load_tree(spark: SparkSession, path: str) -> Tree:
    """A tree that `build_tree` has written under `path`."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/level=*")
    found = sorted(p.getPath().toString() for p in pattern.getFileSystem(conf).globStatus(pattern))
    return Tree([spark.read.parquet(p) for p in found])


def compare(original: Tree, replica: Tree, key: str) -> DataFrame:
    """(key, status, offset, bytes) of each leaf that differs: corrupt, missing (not in the replica) or extra; offset and
    bytes say where its records lie in the original (in order of keys, those without a key last), null for extra ones."""
    top = max(len(original.levels), len(replica.levels)) - 1
    one, two = original.lifted(top), replica.lifted(top)
    wanted = None
    for k in range(top, -1, -1):
        a, b = one[k], two[k]
        name = ["name"] if k == 0 else []
        if wanted is None:
            # the root: at most four topmost ranges
            order = Window.orderBy(*_AT)
            a = a.withColumn("start", F.lit(0).cast("long"))
        else:
            up = [*_AT[:1], F.shiftright("node", BITS).alias("parent")]
            parents = wanted.select("keyless", F.col("node").alias("parent"), "start")
            a = a.select("*", *up[1:]).join(parents, ["keyless", "parent"])
            b = b.select("*", *up[1:]).join(parents.select("keyless", "parent"), ["keyless", "parent"], "left_semi")
            order = Window.partitionBy("keyless", "parent").orderBy("node")
        before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        a = a.select(*_AT, *name, "hash", "bytes", (F.col("start") + before).alias("start"))
        other = b.select(*_AT, *[F.col(c).alias("other_name") for c in name], F.col("hash").alias("other"))
        wanted = staging.staged(a.join(other, _AT, "full").where(~F.col("hash").eqNullSafe(F.col("other"))), "fixity-differs")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("corrupt")
    return wanted.select(F.coalesce("name", "other_name").alias(key), status.alias("status"), F.col("start").alias("offset"), "bytes")


def audit(original: DataFrame, replica: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`compare` for trees built here."""
    return compare(build_tree(original, key, fields), build_tree(replica, key, fields), key)
