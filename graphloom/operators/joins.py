"""Join helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_matches(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys that have exactly one row, with its value; a key with several has no match."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def remap(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Column through mapping (old, new); values without an entry stay."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return df.join(m, df[column] == m["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def canonical(column: str = "source", other: str = "target") -> tuple[Column, Column]:
    return pair_key(F.col(column), F.col(other))
