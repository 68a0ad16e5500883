"""Queries of problem 3: differences between two systems' copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators.compare import FILE_STATS, STRUCTURE_ISSUE, compare_copies
from driftmark.runtime import table


def _differences(spark: SparkSession, d: str) -> DataFrame:
    stats = compare_copies(table(spark, d, "file_stats_primary"), table(spark, d, "file_stats_replica"), FILE_STATS)
    issues = compare_copies(table(spark, d, "structure_issue_primary"), table(spark, d, "structure_issue_replica"), STRUCTURE_ISSUE)
    return stats.select(
        F.lit("file_stats").alias("tab"), "run_id", "path", F.lit("").alias("reason"), "field", "primary_value", "replica_value"
    ).unionByName(issues.select(
        F.lit("structure_issue").alias("tab"), "run_id", F.col("file_path").alias("path"), "reason", "field", "primary_value", "replica_value"
    ))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _differences(spark, d).select("tab", "run_id", "path", "reason", "field")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """How many keys differ, by table and field."""
    return _differences(spark, d).groupBy("tab", "field").agg(F.count(F.lit(1)).alias("n_keys"), F.count_distinct("run_id").alias("n_runs"))


_BLANKS = r"'[\s\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+'"
_BASE = f"""
WITH fp AS (SELECT run_id, path, additions, deletions FROM file_stats_primary
            QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY loaded_at DESC NULLS LAST, additions DESC NULLS LAST, deletions DESC NULLS LAST) = 1),
     fr AS (SELECT run_id, path, additions, deletions FROM file_stats_replica
            QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY loaded_at DESC NULLS LAST, additions DESC NULLS LAST, deletions DESC NULLS LAST) = 1),
     ip AS (SELECT run_id, file_path, reason, source_compact, target_compact FROM structure_issue_primary
            QUALIFY row_number() OVER (PARTITION BY run_id, file_path, reason ORDER BY loaded_at DESC NULLS LAST, source_compact DESC NULLS LAST, target_compact DESC NULLS LAST) = 1),
     ir AS (SELECT run_id, file_path, reason, source_compact, target_compact FROM structure_issue_replica
            QUALIFY row_number() OVER (PARTITION BY run_id, file_path, reason ORDER BY loaded_at DESC NULLS LAST, source_compact DESC NULLS LAST, target_compact DESC NULLS LAST) = 1),
     f AS (SELECT coalesce(p.run_id, r.run_id) AS run_id, coalesce(p.path, r.path) AS path, p.x AS px, r.x AS rx,
                  p.additions AS pa, r.additions AS ra, p.deletions AS pd, r.deletions AS rd
           FROM (SELECT *, 1 AS x FROM fp) p FULL JOIN (SELECT *, 1 AS x FROM fr) r
           ON p.run_id IS NOT DISTINCT FROM r.run_id AND p.path IS NOT DISTINCT FROM r.path),
     i AS (SELECT coalesce(p.run_id, r.run_id) AS run_id, coalesce(p.file_path, r.file_path) AS path, coalesce(p.reason, r.reason) AS reason, p.x AS px, r.x AS rx,
                  regexp_replace(p.source_compact, {_BLANKS}, '', 'g') AS ps, regexp_replace(r.source_compact, {_BLANKS}, '', 'g') AS rs,
                  regexp_replace(p.target_compact, {_BLANKS}, '', 'g') AS pt, regexp_replace(r.target_compact, {_BLANKS}, '', 'g') AS rt
           FROM (SELECT *, 1 AS x FROM ip) p FULL JOIN (SELECT *, 1 AS x FROM ir) r
           ON p.run_id IS NOT DISTINCT FROM r.run_id AND p.file_path IS NOT DISTINCT FROM r.file_path AND p.reason IS NOT DISTINCT FROM r.reason),
     found AS (
       SELECT 'file_stats' AS tab, run_id, path, '' AS reason, 'missing_in_primary' AS field FROM f WHERE px IS NULL
       UNION ALL SELECT 'file_stats', run_id, path, '', 'missing_in_replica' FROM f WHERE rx IS NULL
       UNION ALL SELECT 'file_stats', run_id, path, '', 'additions' FROM f WHERE px = 1 AND rx = 1 AND pa IS DISTINCT FROM ra
       UNION ALL SELECT 'file_stats', run_id, path, '', 'deletions' FROM f WHERE px = 1 AND rx = 1 AND pd IS DISTINCT FROM rd
       UNION ALL SELECT 'structure_issue', run_id, path, reason, 'missing_in_primary' FROM i WHERE px IS NULL
       UNION ALL SELECT 'structure_issue', run_id, path, reason, 'missing_in_replica' FROM i WHERE rx IS NULL
       UNION ALL SELECT 'structure_issue', run_id, path, reason, 'source_compact' FROM i WHERE px = 1 AND rx = 1 AND ps IS DISTINCT FROM rs
       UNION ALL SELECT 'structure_issue', run_id, path, reason, 'target_compact' FROM i WHERE px = 1 AND rx = 1 AND pt IS DISTINCT FROM rt)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
SQL = {
    "p3_found": _BASE + "SELECT tab, run_id, path, reason, field FROM found",
    "p3_report": _BASE + "SELECT tab, field, count(*) AS n_keys, count(DISTINCT run_id) AS n_runs FROM found GROUP BY tab, field",
}
