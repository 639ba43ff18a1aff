"""Change detection, upserts and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def change_set(stored: DataFrame, current: DataFrame) -> DataFrame:
    """file_path, status (new, modified, deleted, unchanged) from tables of file_path and file_hash."""
    a, b = stored.select("file_path", F.col("file_hash").alias("old")), current.select("file_path", F.col("file_hash").alias("new"))
    status = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, "file_path", "full").select("file_path", status.alias("status"))


def is_cache_hit(stored: DataFrame, current: DataFrame, force: bool = False) -> bool:
    """Nothing changed since something was stored."""
    if force or not stored.limit(1).count():
        return False
    return not change_set(stored, current).where("status <> 'unchanged'").limit(1).count()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """old with the rows of new in place of those with equal keys; of equal rows in new the last by order."""
    order = order if order is not None else F.lit(0)
    last = new.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))).where("__r = 1").drop("__r")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def apply_changes(chunks: DataFrame, files: DataFrame, changes: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chunks after changes: only new and modified files are parsed, the others' chunks stay."""
    touched = changes.where("status <> 'unchanged'").select("file_path")
    fresh = parse(files.join(changes.where("status in ('new', 'modified')").select("file_path"), "file_path", "left_semi"))
    return chunks.join(touched, "file_path", "left_anti").unionByName(fresh.select(*chunks.columns))


def corpus_stats(files: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return files.agg(F.count("*").alias("total_files"), zero("chunk_count").alias("total_chunks"), zero("total_lines").alias("total_lines"), zero("total_bytes").alias("total_bytes"))


def manifest(files: DataFrame, seconds: float) -> DataFrame:
    """The counts of an indexing run as keys with JSON values."""
    s = corpus_stats(files).withColumn("seconds", F.lit(float(seconds))).withColumn("lines_per_second", F.col("total_lines") / F.greatest("seconds", F.lit(0.001)))
    return s.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.to_json(F.struct(F.col(c).alias("value"))).alias("value")) for c in s.columns))).alias("x")).select("x.*")
