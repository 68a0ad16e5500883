"""Aggregates and ordered folds: report levels, run summaries, packing, ledgers.

IDs: JOIN1 AGG1-AGG13 SNK6 SRC12 JOIN15 SET4 SRT2 SRT3 SRT5 SRT6 DIF15-DIF17.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def report_levels(target: DataFrame, source: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Rows of the target with the differences to the source and ``level``: exact, within, exceed, target_only, or empty for other files than Markdown."""
    s = source.select(*keys, F.col("additions").alias("sa"), F.col("deletions").alias("sd"), F.lit(True).alias("in_source"))
    j = target.join(s, keys, "left")
    zero = F.lit(0)

    def gap(t: str, c: str) -> Column:
        return F.when(F.col("is_md"), F.abs(F.coalesce(F.col(t), zero) - F.coalesce(F.col(c), zero)))

    rows = j.withColumn("add_diff", gap("additions", "sa")).withColumn("del_diff", gap("deletions", "sd")).withColumn("in_source", F.coalesce("in_source", F.lit(False)))
    level = (
        F.when(~F.coalesce("is_md", F.lit(False)), "").when(~F.col("in_source"), "target_only").when((F.col("add_diff") == 0) & (F.col("del_diff") == 0), "exact")
        .when((F.col("add_diff") > threshold) | (F.col("del_diff") > threshold), "exceed").otherwise("within"))
    return rows.select(*keys, "is_md", "in_source", "add_diff", "del_diff", level.alias("level"))


def greedy_chunks(items: DataFrame, keys: list[str], pos: str, size: str, most: int, limit: int) -> DataFrame:
    """``chunk_no`` (from 1) of each item: in order, a chunk ends before it would hold more than ``most`` items or exceed ``limit``.

    An item above the limit is a chunk of its own. The sum resets as it goes, which no window can express, so it
    is one fold over the sizes of a document.
    """
    rows = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("s")))).alias("v"))
    fold = (
        "aggregate(v, named_struct('no', 0, 'n', 0, 's', 0L, 'out', CAST(array() AS array<int>)), (a, x) -> "
        f"CASE WHEN a.n = 0 OR a.n >= {most} OR a.s + x.s > {limit} THEN named_struct('no', a.no + 1, 'n', 1, 's', x.s, 'out', concat(a.out, array(a.no + 1))) "
        "ELSE named_struct('no', a.no, 'n', a.n + 1, 's', a.s + x.s, 'out', concat(a.out, array(a.no))) END, a -> a.out)")
    return rows.select(*keys, F.explode(F.arrays_zip(F.col("v"), F.expr(fold).alias("c"))).alias("z")).select(*keys, F.col("z.v.p").alias(pos), F.col("z.v.s").alias(size), F.col("z.c").alias("chunk_no"))


def status_summary(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """Counts per status and of all that aren't skipped, as one row."""
    return outcomes.agg(
        *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in ("success", "partial", "failed", "skipped")],
        F.count_if(F.col(status) != "skipped").alias("n_total"), F.coalesce(F.bool_and(F.col(status).isin("success", "skipped")), F.lit(True)).alias("all_done"))


def pending_ledger(pending: DataFrame, outcomes: DataFrame, keys: list[str], ref: str) -> DataFrame:
    """The ledger after a run: what was pending and isn't completed keeps its ref, what failed anew gets the run's. One row per key."""
    done = F.col("status").isin("success", "skipped")
    both = pending.select(*keys, F.lit(0).alias("t"), F.col(ref).alias("r"), F.lit(False).alias("done")).unionByName(
        outcomes.select(*keys, F.lit(1).alias("t"), F.col(ref).alias("r"), F.coalesce(done, F.lit(False)).alias("done")))
    per = both.groupBy(*keys).agg(F.min_by("r", "t").alias(ref), F.bool_or("done").alias("done"))
    return per.where("NOT done").select(*keys, ref)


def mapping_problems(mapping: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Rows of a mapping that break it: ``problem`` is duplicate_target, missing_target or level_mismatch."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys, target))
    rows = mapping.withColumn("__n", n)
    problems = F.array_compact(F.array(
        F.when(F.col(target).isNull(), "missing_target"), F.when(F.col(target).isNotNull() & (F.col("__n") > 1), "duplicate_target"),
        F.when(F.col(target).isNotNull() & (F.col("source_level") != F.col("target_level")), "level_mismatch")))
    return rows.select(*keys, source, target, F.explode(problems).alias("problem"))


def apply_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rank`` of updates in the order in which they may be applied without moving each other: from the bottom of the file up, appended ones last in source order."""
    phase = F.when(F.col("target_line") == -1, 2).otherwise(1)
    w = W.partitionBy(*keys).orderBy("phase", F.when(F.col("target_line") != -1, -F.col("target_line")), F.col("apply_id"))
    return rows.withColumn("phase", phase).select(*keys, "apply_id", "target_line", F.row_number().over(w).alias("rank"))


def keyed_changes(base: DataFrame, head: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``change`` per key: added, deleted or modified, values compared without outer blanks; equal ones are left out."""
    both = base.select(*keys, F.trim(F.col(value)).alias("b"), F.lit(None).cast("string").alias("h"), F.lit(1).alias("in_b"), F.lit(0).alias("in_h")).unionByName(
        head.select(*keys, F.lit(None).cast("string").alias("b"), F.trim(F.col(value)).alias("h"), F.lit(0).alias("in_b"), F.lit(1).alias("in_h")))
    per = both.groupBy(*keys).agg(F.max("b").alias("b"), F.max("h").alias("h"), F.max("in_b").alias("in_b"), F.max("in_h").alias("in_h"))
    change = F.when(F.col("in_b") == 0, "added").when(F.col("in_h") == 0, "deleted").when(~F.col("b").eqNullSafe(F.col("h")), "modified")
    return per.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")
