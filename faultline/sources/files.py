"""Raw inputs: debug log files, metadata backups, landed API listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.debug_logs import split_text

APEX_LISTING = "Id string, Name string, NamespacePrefix string, ApiVersion string, LengthWithoutComments bigint, Body string"
FLOW_LISTING = "Id string, FullName string, NamespacePrefix string, ActiveVersionId string, VersionNumber bigint, Status string, Metadata string"
KINDS = {"classes": ("class", ".cls"), "triggers": ("trigger", ".trigger"), "flows": ("flow", ".flow"), "objects": ("object", ".object")}


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files as text; bytes that are not UTF-8 become the replacement character."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every log file, numbered; the first line is the header."""
    files = _files(spark, folder).withColumn("log_id", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    return split_text(files, "log_id", "text")


def backup(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of a metadata backup with kind, name and content; bundles keep one row per file."""
    files = _files(spark, folder)
    part = F.split("path", "/")
    parent, file = F.element_at(part, -2), F.element_at(part, -1)
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for directory, (k, suffix) in KINDS.items():
        hit = (parent == directory) & file.endswith(suffix)
        kind = F.when(hit, k).otherwise(kind)
        name = F.when(hit, F.regexp_replace(file, f"{suffix.replace('.', '[.]')}$", "")).otherwise(name)
    bundle = F.element_at(part, -3) == "lwc"
    kind, name = F.when(bundle, "lwc").otherwise(kind), F.when(bundle, parent).otherwise(name)
    unit = F.when(bundle, F.concat(F.lit("lwc/"), parent)).otherwise(F.concat_ws("/", parent, file))
    return files.select(unit.alias("unit"), kind.alias("kind"), name.alias("name"), file.alias("file"), "text").filter("kind IS NOT NULL")


def listing(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Landed API responses, one record per line, read with a fixed schema."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
