"""Documents to token files: language, near duplicates, benchmark passages, source mix, token ids.

Every stage takes what its predecessor kept, as columns of `documents`; the last returns the index of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankengine.llm import decontamination, language_id, mixing, near_dup, token_files
from rankengine.llm.queries import tokenizer_path
from rankengine.llm.staging import mark, new_path, release, remainder
from rankengine.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty ones, too), also when no language was learned; the language found
    replaces a missing one. Rows count each by itself, whatever their doc_id; of tied languages the first by name is taken.
    Texts of any length are read whole; an empty table gives an empty one; extra columns are dropped."""
    ship(spark)
    found = language_id.identify(docs.select(F.struct(*COLUMNS).alias("doc_id"), "text"), language_id.learn(docs, remainder(3) != 1))
    kept = found.where("n_letters > 0").select("doc_id.*", "lang_pred")
    return kept.withColumn("lang", F.coalesce("lang", F.expr("nullif(lang_pred, 'und')"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near duplicates (five words, 0.8), in the order of doc_id (null last), then of
    the text's hash. Rows count each by itself: of equal rows one is kept, of different texts under one id, or under none,
    all that aren't near duplicates. Texts without words are near duplicates of nothing, so all of them stay. Texts of any
    length are read whole; an empty table gives an empty one; extra columns are dropped."""
    ship(spark)
    rows = near_dup.numbered(docs.select(COLUMNS), "near-input")
    groups = near_dup.row_groups(rows.select(F.col("row").alias("doc_id"), "text"), 5, 80, near_dup.Banding.at(80))
    groups = groups.select(F.col("doc_id").alias("row"), "component_id")
    kept = rows.select("row", near_dup.first_row().alias("place")).join(groups, "row").groupBy("component_id").agg(F.min("place").alias("place"))
    return rows.join(kept.select("place.row"), "row", "left_semi").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window. Rows count each by itself; null and empty texts hold nothing and stay;
    texts of any length are read whole; with an empty benchmark all rows stay; extra columns are dropped."""
    ship(spark)
    rows = near_dup.numbered(docs.select(COLUMNS), "overlap-input")
    found = decontamination.find_overlaps(rows.select(F.col("row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.where("n_hit > 0").select(F.col("doc_id").alias("row")), "row", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, rounded to whole documents (at most one document a source and
    pass is cut by the mix). Documents without words (null and empty ones, too) are taken 0 times, so they go. Equal rows
    of a source share their copies evenly, up to rounding. A null source is one of its own, the last; rows count whatever
    their doc_id; texts of any length are read whole; an empty table gives an empty one; extra columns are dropped."""
    ship(spark)
    row = F.struct("doc_id", "source", "key")
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)
    taken = mixing.mix(docs).select(row.alias("row"), times.alias("times")).groupBy("row").agg(F.floor(F.avg("times") + 0.5).cast("int").alias("times"))
    rows = docs.select(COLUMNS).withColumn("key", mixing.shuffle_key()).withColumn("row", row).join(taken.where("times > 0"), "row")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and their index: doc_id, start, n_tokens, ids_crc32. Null and empty texts hold the end id
    alone; rows of one doc_id (copies, too) stay apart, in no fixed order among them, null ones come first; texts of any
    length are encoded whole; an empty table gives an empty index; extra columns are dropped."""
    ship(spark)
    out = token_files.write_token_files(docs, new_path(spark, "token-files"), tokenizer_path(), piece_bytes=1 << 20, cache=100_000)
    return token_files.read_digests(spark, out)


STAGES = [("language_id", languages), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("token_output", write_tokens)]

#: SQL can't express language identification and token ids; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written as Parquet and read again; what a stage has kept for itself in the
    shared folder goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since, path = mark(spark), new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, since, keep=(path,))
    return STAGES[-1][1](spark, docs, sf_dir)
