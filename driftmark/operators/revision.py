"""Following sections from one version to the next, and calling an external function on what is left.

IDs: DIF13 DIF16 DIF20 DIF22 JOIN9 JOIN14 JOIN15 JOIN16 JOIN17 SEQ7 FLT1-FLT4 FLT16 FLT22 EXT1 EXE1 D17 D19. Matching is a
cascade: each phase is an equality join over what the phases before it left, taken out by anti-joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.operators.matching import multiset_positions, unique_key_join
from driftmark.runtime import checkpointed


def match_sections(left: DataFrame, right: DataFrame, keys: list[str], pos: str, phases: list[str]) -> DataFrame:
    """``left_pos``, ``right_pos`` and ``phase`` (from 1) of sections matched by the first of the columns ``phases`` that settles them.

    A phase pairs values that are unique on both sides among what is left; the last one pairs the nth with the nth of
    equal value. Null values match nothing. Each section is in one pair at most.
    """
    out = None
    # Every phase reads what the one before left twice; written down, it isn't computed anew each time.
    a, b = checkpointed(left.select(*keys, pos, *phases)), checkpointed(right.select(*keys, pos, *phases))
    for n, column in enumerate(phases, 1):
        l, r = a.where(F.col(column).isNotNull()), b.where(F.col(column).isNotNull())
        if n < len(phases):
            found = unique_key_join(l, r, [*keys, column], pos)
        else:
            found = multiset_positions(l, r, keys, column, pos).where("right_pos IS NOT NULL")
        found = checkpointed(found.select(*keys, "left_pos", "right_pos", F.lit(n).alias("phase")))
        out = found if out is None else out.unionByName(found)
        a = a.join(found.select(*keys, F.col("left_pos").alias(pos)), [*keys, pos], "left_anti")
        b = b.join(found.select(*keys, F.col("right_pos").alias(pos)), [*keys, pos], "left_anti")
    return out


def moved_sections(base: DataFrame, head: DataFrame, keys: list[str], title: str, parent: str, pos: str) -> DataFrame:
    """Sections of unique title whose parent changed, as a delete at the old and an insert at the new place."""
    pairs = unique_key_join(base, head, [*keys, title], pos)
    pairs = pairs.join(base.select(*keys, F.col(pos).alias("left_pos"), F.col(parent).alias("old_parent")), [*keys, "left_pos"])
    pairs = pairs.join(head.select(*keys, F.col(pos).alias("right_pos"), F.col(parent).alias("new_parent")), [*keys, "right_pos"])
    moved = pairs.where(~F.col("old_parent").eqNullSafe(F.col("new_parent")))
    step = F.explode(F.array(F.struct(F.lit("delete").alias("action"), F.col("left_pos").alias("at")), F.struct(F.lit("insert").alias("action"), F.col("right_pos").alias("at")))).alias("x")
    return moved.select(*keys, title, "old_parent", "new_parent", step).select(*keys, title, "old_parent", "new_parent", "x.action", "x.at")


def replacements(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (``old``, ``new``) lines of blocks of changes that replace as many lines as they put in, the nth by the nth, with ``n`` and the first place."""
    w = W.partitionBy(*keys).orderBy("diff_index")
    rows = ops.where("op != 'context'").withColumn("b", (F.coalesce(F.col("diff_index") - F.lag("diff_index").over(w), F.lit(2)) > 1).cast("int")).withColumn("block", F.sum("b").over(w))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys, "block", "op").orderBy("diff_index")))
    pairs = rows.groupBy(*keys, "block", "nth").agg(
        F.max(F.when(F.col("op") == "deleted", F.col("content"))).alias("old"), F.max(F.when(F.col("op") == "added", F.col("content"))).alias("new"), F.min("diff_index").alias("at"))
    even = F.bool_and(F.col("old").isNotNull() & F.col("new").isNotNull()).over(W.partitionBy(*keys, "block"))
    return pairs.withColumn("even", even).where("even AND old != new").groupBy(*keys, "old", "new").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))


def find_runs(needles: DataFrame, hay: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Where a run of values stands in another, if in exactly one place: ``start``. All needle rows of a key are one run in the order of ``pos``.

    Equal values are joined once and grouped by their offset; an offset that all of the run share is a place.
    """
    n = needles.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(pos))).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    h = hay.withColumn("__j", F.row_number().over(W.partitionBy(*keys).orderBy(pos)))
    hits = n.select(*keys, value, "__i", "__n").join(h.select(*keys, value, "__j"), [*keys, value])
    places = hits.groupBy(*keys, (F.col("__j") - F.col("__i")).alias("__o"), "__n").agg(F.count(F.lit(1)).alias("c")).where("c = __n")
    return places.groupBy(*keys).agg(F.min("__o").alias("o"), F.count(F.lit(1)).alias("c")).where("c = 1").select(*keys, (F.col("o") + 1).alias("start"))


def by_prefix(short: DataFrame, full: DataFrame, short_col: str, full_col: str, least: int = 7) -> DataFrame:
    """Rows whose abbreviated id is the beginning of a full one. Joined on the first ``least`` characters; shorter ids match nothing."""
    a = short.where(F.length(short_col) >= least).withColumn("__p", F.substring(short_col, 1, least))
    b = full.withColumn("__p", F.substring(full_col, 1, least))
    return a.join(b, "__p").where(F.startswith(F.col(full_col), F.col(short_col))).drop("__p")


def in_scope(files: DataFrame, paths: DataFrame, path_col: str) -> DataFrame:
    """Changed files whose present or previous name is among the paths."""
    names = files.withColumn("__p", F.explode(F.array_distinct(F.array_compact(F.array("filename", "previous_filename")))))
    wanted = paths.select(F.col(path_col).alias("__p")).where("__p IS NOT NULL").distinct()
    return names.join(wanted, "__p", "left_semi").drop("__p").dropDuplicates()


def without_folders(files: DataFrame, path: str, folders: list[str]) -> DataFrame:
    """Files outside the given folders; a null path is kept."""
    clean = [f.strip("/") for f in folders if f and f.strip("/")]
    if not clean:
        return files
    keep = F.lit(True)
    for f in clean:
        keep = keep & ~((F.col(path) == f) | F.col(path).startswith(f + "/"))
    return files.where(F.coalesce(keep, F.lit(True)))


def merge_blocks(base: DataFrame, changes: DataFrame, keys: list[str], letter: str, content: str) -> DataFrame:
    """Lettered blocks after replacing and adding those of ``changes`` (null content removes one), put together in the order of their letters."""
    both = base.select(*keys, letter, F.lit(0).alias("r"), F.col(content).alias("c")).unionByName(changes.select(*keys, letter, F.lit(1).alias("r"), F.col(content).alias("c")))
    best = both.groupBy(*keys, letter).agg(F.max(F.struct("r", F.col("c").alias("c"))).alias("x")).where("x.c IS NOT NULL")
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(letter).alias("l"), F.col("x.c").alias("c")))).alias("v")).select(
        *keys, F.array_join(F.transform("v", lambda x: x["c"]), "\n").alias(content))


def call_external(rows: DataFrame, text: str, function: Callable[[str], str] | None = None) -> DataFrame:
    """``rows`` with ``reply``, ``status`` (success, failed, skipped) and ``reason`` of an external function of the text.

    The default is the identity. A failure of one row is that row's outcome, never the job's. Null texts are skipped. A
    function that isn't deterministic must have its result written before it is used twice.
    """
    from driftmark.runtime import ship

    ship(rows.sparkSession)
    call = function or (lambda t: t)

    @F.pandas_udf("reply string, status string, reason string")
    def run(texts):
        import pandas as pd

        out = []
        for t in texts:
            if t is None:
                out.append((None, "skipped", "no text"))
                continue
            try:
                out.append((call(t), "success", None))
            except Exception as e:  # noqa: BLE001
                out.append((None, "failed", f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["reply", "status", "reason"])

    return rows.withColumn("__x", run(F.col(text))).select(*rows.columns, "__x.reply", "__x.status", "__x.reason")
