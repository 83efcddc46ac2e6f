"""Manifest queries over the document snapshots."""

from pyspark.sql import functions as F

from faultline.operators import manifests as m
from faultline.plans.registry import query
from faultline.sources.tables import table
from faultline.sources.views import AS_OF, view

DIFF = """(SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS status
  FROM <manifest_after> a FULL JOIN <manifest_before> b ON a.path = b.path)"""
N = ", ".join(f"sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END)::BIGINT AS {s}" for s in ("added", "changed", "removed", "unchanged"))


def diff(spark, root):
    return m.compare(view(spark, root, "manifest_before"), view(spark, root, "manifest_after"))


@query("manifest_diff", f"SELECT * FROM {DIFF} d")
def manifest_diff(spark, root):
    return diff(spark, root)


@query("manifest_diff_by_kind", f"SELECT split_part(path, '/', 1) AS kind, {N} FROM {DIFF} d GROUP BY 1")
def manifest_diff_by_kind(spark, root):
    return m.by_kind(diff(spark, root))


@query("manifest_totals", f"SELECT *, added + changed + unchanged AS total, changed + removed + unchanged = 0 AS first_connection FROM (SELECT {N} FROM {DIFF} d) s")
def manifest_totals(spark, root):
    return m.totals(m.by_kind(diff(spark, root)))


@query("manifest_samples", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path) AS place FROM {DIFF} d WHERE status <> 'unchanged') x WHERE place <= 8
""")
def manifest_samples(spark, root):
    return m.samples(diff(spark, root))


@query("manifest_merge", """
SELECT a.path, a.hash, coalesce(strftime(DATE '2024-01-30' - CAST(b.age_days + 30 AS INTEGER), '%Y-%m-%d'), '2024-01-30') AS first_seen,
  CASE WHEN a.hash = b.hash THEN strftime(DATE '2024-01-30' - CAST(b.age_days AS INTEGER), '%Y-%m-%d') ELSE '2024-01-30' END AS last_changed
FROM <manifest_after> a LEFT JOIN <manifest_before> b ON a.path = b.path
""")
def manifest_merge(spark, root):
    day = F.lit(AS_OF).cast("date")
    before = view(spark, root, "manifest_before").select(
        "path", "hash", F.date_format(F.date_sub(day, F.col("age_days").cast("int") + 30), "yyyy-MM-dd").alias("first_seen"),
        F.date_format(F.date_sub(day, F.col("age_days").cast("int")), "yyyy-MM-dd").alias("last_changed"),
    )
    return m.merged(before, view(spark, root, "manifest_after"), AS_OF)


@query("extraction_log", f"""
SELECT *, added + changed + unchanged AS total, changed + removed + unchanged = 0 AS first_connection, 'run_1' AS run_id, '2024-01-30T00:00:00Z' AS run_at FROM (SELECT {N} FROM {DIFF} d) s
""")
def extraction_log(spark, root):
    return m.run_record(diff(spark, root), "run_1", f"{AS_OF}T00:00:00Z")


@query("extraction_removed", f"SELECT 'run_1' AS run_id, path FROM {DIFF} d WHERE status = 'removed'")
def extraction_removed(spark, root):
    return m.removed_paths(diff(spark, root), "run_1")


@query("sources_to_extract", """
SELECT path, hash FROM <manifest_after> a WHERE (path, hash) NOT IN (SELECT path, hash FROM <manifest_before> b)
""")
def sources_to_extract(spark, root):
    version = F.lit("3.3.0")
    after = view(spark, root, "manifest_after").withColumn("extractor_version", version)
    done = view(spark, root, "manifest_before").select("path", "hash").withColumn("extractor_version", version)
    return m.to_extract(after, done).select("path", "hash")


@query("unit_hashes", """
SELECT CAST(conv_id AS VARCHAR) AS unit, sha256(string_agg(text, '' ORDER BY lpad(CAST(turn AS VARCHAR), 9, '0'))) AS hash, count(*) AS files FROM {conversations} GROUP BY 1
""")
def unit_hashes(spark, root):
    turns = table(spark, root, "conversations").withColumn("path", F.lpad(F.col("turn").cast("string"), 9, "0"))
    return m.unit_hashes(turns, "conv_id", "path", "text")
