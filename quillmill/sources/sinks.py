"""Sinks: partitioned tables, JSON lines, reports, exports and upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(df: DataFrame, path: str, by: str = "category") -> None:
    """Parquet partitioned by category, replacing what was there."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_training(split: DataFrame, path: str) -> None:
    """train and val as JSON lines in one pass, a folder per part; only the text survives."""
    split.select("split", "text").write.mode("overwrite").partitionBy("split").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


INDEX_VERSION = "1.0"


def write_index(passages: DataFrame, path: str, key: str = "category") -> None:
    """An index: its entries as a table, and one row with version, number of entries and the distinct categories in order."""
    passages.write.mode("overwrite").parquet(f"{path}/entries")
    read_index(passages.sparkSession, path)[0].agg(F.lit(INDEX_VERSION).alias("version"), F.count("*").alias("total"), F.array_sort(F.collect_set(key)).alias("categories")).write.mode("overwrite").json(f"{path}/header")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(entries, header) of a written index; the header is None while it is not there yet."""
    entries = spark.read.parquet(f"{path}/entries")
    try:
        return entries, spark.read.schema("version string, total bigint, categories array<string>").json(f"{path}/header")
    except AnalysisException:
        return entries, None


def append(df: DataFrame, path: str) -> None:
    """Append-only tables: knowledge records, feedback rows."""
    df.write.mode("append").parquet(path)


def write_examples(df: DataFrame, path: str) -> None:
    """Training examples partitioned by type; subsets are filters on it."""
    df.write.mode("overwrite").partitionBy("example_type").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows replaced by the new ones with their key, plus new keys; a null key never matches."""
    keys = new.select(F.col(key).alias("_k")).filter("_k is not null").distinct()
    return old.join(keys, F.col(key) == F.col("_k"), "left_anti").unionByName(new, allowMissingColumns=True)


def rounded_results(df: DataFrame) -> DataFrame:
    """Result export: confidence to 3, cost to 6 places."""
    return df.withColumns({c: F.bround(c, n) for c, n in (("confidence", 3), ("cost", 6)) if c in df.columns})
