"""What the text operators share: staged tables, the document table, the division into learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import mark, new_path, release, shared_dir, staged

__all__ = ["documents", "mark", "new_path", "release", "remainder", "shared_dir", "staged", "text_bytes"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def remainder(n: int):
    """crc32 of doc_id as text, modulo n: how rows are divided into learning and held-out rows."""
    return F.crc32(F.col("doc_id").cast("string")) % n
