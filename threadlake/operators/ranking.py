"""Counts, ranks and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys, order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def label_rank(df: DataFrame, keys, label: str, seen: Column, k: int, name: str = "rank") -> DataFrame:
    """(keys, label, n, rank): the commonest labels; ties go to the label met first, by `seen`."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(seen).alias("_seen"))
    return top_k(counts, keys, [F.desc("n"), F.col("_seen")], k, name).drop("_seen")
