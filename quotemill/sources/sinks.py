"""Results written out, or as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(results: DataFrame) -> DataFrame:
    """(doc_id, json) of results(doc_id, summary, groups)."""
    return results.select("doc_id", F.to_json(F.struct("summary", "groups")).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet(results: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = results.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def overview(items: DataFrame) -> DataFrame:
    """One row: documents, groups (by quantity), items, their quantity and their cost."""
    groups = items.groupBy("doc_id", "quantity").agg(F.count(F.lit(1)).alias("items"), F.sum("cost").alias("cost"))
    return groups.agg(
        F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("groups"), F.sum("items").alias("items"), F.sum(F.coalesce("quantity", F.lit(1)).cast("long") * F.col("items")).alias("total_quantity"), F.round(F.sum("cost"), 2).alias("total_cost")
    )
