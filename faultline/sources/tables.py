"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def bind(spark: SparkSession, root: str, sql: str) -> DataFrame:
    """Run SQL that names tables in braces, reading only those it names."""
    used = {n: table(spark, root, n) for n in NAMES if "{" + n + "}" in sql}
    return spark.sql(sql, **used)
