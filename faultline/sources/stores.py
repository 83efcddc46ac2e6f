"""Derived tables on storage: knowledgebase, normalised logs, incidents, run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWLEDGEBASE = (
    "cards call_edges call_sites field_writes entry_filters entry_points facts object_touch manifest org_statistics"
).split()


def save_knowledgebase(tables: dict[str, DataFrame], folder: str) -> None:
    """Replace the partitions of the orgs present in each table; other orgs keep theirs."""
    for name, df in tables.items():
        if name not in KNOWLEDGEBASE:
            raise ValueError(f"unknown knowledgebase table {name}")
        df.write.partitionBy("org_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{name}")


def load_knowledgebase(spark: SparkSession, folder: str, org_id: str | None = None) -> dict[str, DataFrame]:
    found = {}
    for name in KNOWLEDGEBASE:
        try:
            df = spark.read.parquet(f"{folder}/{name}")
        except Exception as e:  # a table never saved, or saved without a row, reads as absent
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        found[name] = df if org_id is None else df.filter(F.col("org_id") == org_id)
    return found


def save_section(section: DataFrame, name: str, folder: str) -> None:
    section.write.mode("append").parquet(f"{folder}/{name}")


def load_section(spark: SparkSession, name: str, folder: str, log_id: object | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}")
    return df if log_id is None else df.filter(F.col("log_id") == log_id)


def list_logs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/log_meta").orderBy(F.desc("log_id"))


def download_log(sections: dict[str, DataFrame], log_id: object, out: str) -> None:
    """All sections of one log as JSON lines, one folder per section."""
    for name, df in sections.items():
        df.filter(F.col("log_id") == log_id).write.mode("overwrite").json(f"{out}/{name}")


def save_incidents(incidents: DataFrame, folder: str) -> None:
    incidents.write.partitionBy("org_id").mode("append").parquet(folder)


def list_incidents(spark: SparkSession, folder: str, org_id: str) -> DataFrame:
    return spark.read.parquet(folder).filter(F.col("org_id") == org_id).orderBy(F.desc("incident_id"))


def load_incident(spark: SparkSession, folder: str, org_id: str, incident_id: object) -> DataFrame:
    return spark.read.parquet(folder).filter((F.col("org_id") == org_id) & (F.col("incident_id") == incident_id))


def append_run(record: DataFrame, folder: str) -> None:
    record.write.mode("append").parquet(folder)


def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("org_id").agg(F.count(F.lit(1)).alias("runs"))
