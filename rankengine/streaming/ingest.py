"""Raw rows as streams: micro-batch append with exactly-once output, and the latest progress row of each key.

Progress rows of a batch lie in a folder of their own. Every MERGE_EVERY batches they are merged into a base in BUCKETS
buckets of keys, of which a manifest names the folders. So what a read costs grows with the keys, not with the batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import latest_per_key
from ..operators.storage import staged

MERGE_EVERY = 20
BUCKETS = 64


def start_ingest(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100, continuous: bool = False) -> StreamingQuery:
    """Appends every new file under `source` to the Parquet table `out`, each row once; stops when all is read, or keeps
    a micro-batch every 2 seconds."""
    rows = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(source)
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="2 seconds") if continuous else writer.trigger(availableNow=True)).start()


def start_progress(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str, progress: Callable[[DataFrame], DataFrame], key: str, order: str, files_per_batch: int = 100) -> StreamingQuery:
    """In each micro-batch the rows are written first, then the progress rows made from them. Each batch has folders of
    its own, overwritten if the batch runs again. After every MERGE_EVERY batches their progress goes into the base."""

    def write(batch: DataFrame, number: int) -> None:
        if number - 1 - _newest(spark, out).upto >= MERGE_EVERY:
            merge_progress(spark, out, key, order, number - 1)  # earlier batches are committed: none of them runs again
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        progress(batch).write.mode("overwrite").parquet(f"{out}/progress/batch={number}")
        batch.unpersist()

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Base:
    """The merged progress of all batches up to `upto`: the folder of each bucket of keys."""

    upto: int
    folders: dict[int, str]


def _names(spark: SparkSession, pattern: str, of: str) -> list[int]:
    """The numbers in finished folders <of>=<number>."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/{of}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(p.getPath().getParent().getName().split("=")[1]) for p in found)


def _newest(spark: SparkSession, out: str) -> Base:
    upto = max(_names(spark, f"{out}/manifest", "upto"), default=-1)
    if upto < 0:
        return Base(-1, {})
    rows = spark.read.schema("bucket int, folder string").json(f"{out}/manifest/upto={upto}").collect()  # BUCKETS rows at most
    return Base(upto, {r["bucket"]: r["folder"] for r in rows})


def merge_progress(spark: SparkSession, out: str, key: str, order: str, upto: int) -> None:
    """Merges the batches up to `upto` that aren't in the base yet into it. Only buckets with new keys are written anew.

    The manifest is written last: a merge that stops before leaves the old base valid, and is done again. Batches that the
    base before this one held already are deleted, so readers that began with it still find theirs.
    """
    base = _newest(spark, out)
    batches = [b for b in _names(spark, f"{out}/progress", "batch") if base.upto < b <= upto]
    if not batches:
        return
    new = spark.read.parquet(*[f"{out}/progress/batch={b}" for b in batches])
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    new = staged(latest_per_key(new, key, order).withColumn("_bucket", bucket), "progress-new")
    touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]
    old = [base.folders[b] for b in touched if b in base.folders]
    rows = new.drop("_bucket")
    if old:
        rows = latest_per_key(rows.unionByName(spark.read.schema(rows.schema).parquet(*[f"{out}/{f}" for f in old])), key, order)
    folder = f"base/upto={upto}"
    rows.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").option("compression", "zstd").parquet(f"{out}/{folder}")
    folders = base.folders | {b: f"{folder}/_bucket={b}" for b in touched}
    spark.createDataFrame(sorted(folders.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").json(f"{out}/manifest/upto={upto}")
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for b in _names(spark, f"{out}/progress", "batch"):
        if b <= base.upto:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/progress/batch={b}"), True)


def latest_progress(spark: SparkSession, out: str, key: str, order: str) -> DataFrame:
    """The last progress row of each key: of the base, and of the batches since, which are MERGE_EVERY or so at most."""
    base = _newest(spark, out)
    since = [f"{out}/progress/batch={b}" for b in _names(spark, f"{out}/progress", "batch") if b > base.upto]
    merged = [f"{out}/{f}" for f in base.folders.values()]
    if not merged:
        return latest_per_key(spark.read.parquet(*since), key, order)
    rows = spark.read.parquet(*merged)
    return latest_per_key(rows.unionByName(spark.read.schema(rows.schema).parquet(*since)), key, order) if since else rows
