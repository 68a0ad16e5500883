"""Unified diffs as line operations, and what follows from them.

IDs: D5 DIF1 DIF3-DIF7 DIF9-DIF12 DIF18 DIF19 SRC13 SRC14 FLT17-FLT19 AGG13 SNK5 inputs. All windows are
partitioned by the diff, which is bounded by one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def operations(diffs: DataFrame, keys: list[str], patch: str) -> DataFrame:
    """A row per line of every hunk: ``diff_index``, ``hunk``, ``op`` (added, deleted, context), ``old_line``, ``new_line``, ``head_line``, ``content``, ``is_header``.

    ``old_line`` of an added line and ``new_line`` of a deleted one are null; ``head_line`` is where a line is in the new text, for a
    deleted one the line that is there now. What precedes the first hunk and the note on a missing last line end are no lines; within a
    hunk every line is one, also a deleted ``-- x``. Null patches have none. For patches of many files cut them apart first.
    """
    w = W.partitionBy(*keys).orderBy("diff_index")
    rows = diffs.where(F.col(patch).isNotNull()).select(*keys, F.posexplode(F.split(F.regexp_replace(F.col(patch), r"\r\n|\r", "\n"), "\n", -1)).alias("diff_index", "raw"))
    rows = rows.withColumn("is_hunk", F.col("raw").rlike(_HUNK).cast("int")).withColumn("hunk", F.sum("is_hunk").over(w))
    sign = F.substring("raw", 1, 1)
    body = rows.where("hunk > 0").withColumn("sign", F.when(F.col("is_hunk") == 1, "@").otherwise(sign))
    body = body.where(F.col("sign").isin("@", "+", "-", " "))
    h = W.partitionBy(*keys, "hunk").orderBy("diff_index")

    def number(group: int, own: str) -> Column:
        start = F.first(F.regexp_extract("raw", _HUNK, group)).over(h).cast("int")
        return F.when(F.col("sign").isin(own, " "), start + F.sum(F.col("sign").isin(own, " ").cast("int")).over(h) - 1).cast("int")

    before = F.first(F.regexp_extract("raw", _HUNK, 2)).over(h).cast("int") + F.sum(F.col("sign").isin("+", " ").cast("int")).over(h)
    head = (before - F.col("sign").isin("+", " ").cast("int")).cast("int")
    body = body.withColumn("old_line", number(1, "-")).withColumn("new_line", number(2, "+")).withColumn("head_line", head).where("sign != '@'")
    content = F.substring("raw", F.lit(2), F.length("raw"))
    op = F.when(F.col("sign") == "+", "added").when(F.col("sign") == "-", "deleted").otherwise("context")
    return body.select(*keys, "diff_index", "hunk", op.alias("op"), "old_line", "new_line", "head_line", content.alias("content"), content.rlike(r"^#{1,10}\s+\S").alias("is_header"))


def line_counts(ops: DataFrame, keys: list[str]) -> DataFrame:
    return ops.groupBy(*keys).agg(
        F.count_if(F.col("op") == "added").alias("additions"), F.count_if(F.col("op") == "deleted").alias("deletions"),
        F.count_if(F.col("op") == "context").alias("context"), F.count_if((F.col("op") != "context") & F.col("is_header")).alias("header_changes"), F.max("hunk").alias("hunks"))


def noop_pairs(ops: DataFrame, keys: list[str]) -> DataFrame:
    """``noop_pairs``: equal lines deleted and added within one block of changes, counted as bags."""
    changed = ops.where("op != 'context'")
    w = W.partitionBy(*keys).orderBy("diff_index")
    gap = (F.coalesce(F.col("diff_index") - F.lag("diff_index").over(w), F.lit(2)) > 1).cast("int")
    blocks = changed.withColumn("begins", gap).withColumn("block", F.sum("begins").over(w))
    per = blocks.groupBy(*keys, "block", "content").agg(F.least(F.count_if(F.col("op") == "added"), F.count_if(F.col("op") == "deleted")).alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("noop_pairs"))


def changed_ranges(ops: DataFrame, keys: list[str], line: str = "new_line", gap: int = 2) -> DataFrame:
    """Runs of added lines that are at most ``gap`` apart: ``range_no``, ``first_line``, ``last_line``, ``n``."""
    w = W.partitionBy(*keys).orderBy(line)
    rows = ops.where(F.col("op") == "added").withColumn("begins", (F.coalesce(F.col(line) - F.lag(line).over(w), F.lit(gap + 1)) > gap).cast("int"))
    rows = rows.withColumn("range_no", F.sum("begins").over(w))
    return rows.groupBy(*keys, "range_no").agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.count(F.lit(1)).alias("n"))


def insertion_groups(ops: DataFrame, keys: list[str], gap: int = 10) -> DataFrame:
    """Added headings within ``gap`` lines form a group, anchored at the last heading before it that isn't added: ``anchor_line`` and ``anchor``."""
    w = W.partitionBy(*keys).orderBy("new_line")
    heads = ops.where("is_header AND op != 'deleted'")
    anchor = F.last(F.when(F.col("op") == "context", F.struct(F.col("new_line").alias("line"), "content")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = heads.withColumn("anchor", anchor).where("op = 'added'")
    rows = rows.withColumn("begins", (F.coalesce(F.col("new_line") - F.lag("new_line").over(w), F.lit(gap + 1)) > gap).cast("int")).withColumn("group_no", F.sum("begins").over(w))
    return rows.groupBy(*keys, "group_no").agg(
        F.count(F.lit(1)).alias("n_headings"), F.min("new_line").alias("first_line"), F.min_by("anchor", "new_line").alias("a")).select(
        *keys, "group_no", "n_headings", "first_line", F.col("a.line").alias("anchor_line"), F.col("a.content").alias("anchor"))


def sides(ops: DataFrame, keys: list[str]) -> DataFrame:
    """The old and the new lines that a diff shows: ``ref`` (base, head), ``line_no``, ``text``, ``level`` and ``changed``."""
    sides_ = F.array(
        F.when(F.col("op") != "added", F.struct(F.lit("base").alias("ref"), F.col("old_line").alias("line_no"))),
        F.when(F.col("op") != "deleted", F.struct(F.lit("head").alias("ref"), F.col("new_line").alias("line_no"))))
    rows = ops.select(*keys, F.explode(F.array_compact(sides_)).alias("x"), F.col("content").alias("text"), (F.col("op") != "context").alias("changed"))
    return rows.select(*keys, "x.ref", "x.line_no", "text", "changed", F.length(F.regexp_extract("text", r"^(#{1,10})\s+\S", 1)).alias("level"))


def containing_sections(both: DataFrame, keys: list[str]) -> DataFrame:
    """For changed lines of the head side the heading above, per section: ``section_line``, ``n_changed``; 0 where none is shown."""
    w = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = both.where("ref = 'head'").withColumn("section_line", F.coalesce(F.last(F.when(F.col("level") > 0, F.col("line_no")), ignorenulls=True).over(w), F.lit(0)))
    return rows.where("changed").groupBy(*keys, "section_line").agg(F.count(F.lit(1)).alias("n_changed"))


def restructured(both: DataFrame, keys: list[str], ratio: float = 0.5, least: int = 2) -> DataFrame:
    """``restructured``: at least ``least`` sub-headings on a side, all of them changed, and at least ``ratio`` of the head's lines."""
    per = both.groupBy(*keys).agg(
        F.count_if((F.col("ref") == "head") & (F.col("level") > 1)).alias("head_subs"), F.count_if((F.col("ref") == "base") & (F.col("level") > 1)).alias("base_subs"),
        F.count_if((F.col("level") > 1) & ~F.col("changed")).alias("kept"),
        F.count_if((F.col("ref") == "head") & F.col("changed")).alias("changed_lines"), F.count_if(F.col("ref") == "head").alias("head_lines"))
    share = F.when(F.col("head_lines") > 0, F.col("changed_lines") / F.col("head_lines")).otherwise(0.0)
    flag = (F.greatest("head_subs", "base_subs") >= least) & (F.col("kept") == 0) & (share >= ratio)
    return per.select(*keys, "head_subs", "base_subs", "kept", share.alias("changed_share"), flag.alias("restructured"))


def level_only_changes(rows: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """Records whose text differs in nothing but the level of its first heading: ``old_level``, ``new_level``."""
    def level(c: str) -> Column:
        return F.length(F.regexp_extract(F.col(c), r"^(#{1,10})\s+\S", 1))

    def rest(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.col(c), r"^#{1,10}\s+", ""), r"\s+$", "")

    return rows.where((level(old) > 0) & (level(new) > 0) & (level(old) != level(new)) & (rest(old) == rest(new))).select(*keys, level(old).alias("old_level"), level(new).alias("new_level"))


def longest_common(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """``lcs``: length of the longest common subsequence of two arrays of strings, in Arrow batches; null arrays count as empty."""
    from driftmark.runtime import ship

    ship(rows.sparkSession)

    @F.pandas_udf("int")
    def lcs(a, b):
        import pandas as pd

        def one(x, y):
            x, y = (list(v) if v is not None else [] for v in (x, y))
            row = [0] * (len(y) + 1)
            for p in x:
                last = 0
                for j, q in enumerate(y):
                    last, row[j + 1] = row[j + 1], last + 1 if p == q else max(row[j + 1], row[j])
            return row[-1]

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return rows.withColumn("lcs", lcs(F.col(left), F.col(right)))


def overlapping(hunks: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Hunks (``first_line``, ``last_line``) that overlap a range (``start``, ``end``) of the same key; semi-join with an equality key."""
    cond = [hunks[k] == ranges[k] for k in keys] + [hunks["first_line"] <= ranges["end"], hunks["last_line"] >= ranges["start"]]
    return hunks.join(ranges, cond, "left_semi")


def heading_prefixes(ops: DataFrame, keys: list[str], wrapper: str = r"^\s*<CustomContent\b[^>]*>\s*$") -> DataFrame:
    """Per added heading the added wrapper lines right above it, which belong to the new section: ``heading_line``, ``first_line``, ``n_lines``, ``n_ignored``.

    Single blank lines may stand between; a second one, any other line, or a line that isn't added ends the prefix. Blank lines at
    its top don't count in ``n_lines``, but are ignored as changes all the same. Headings without a wrapper above aren't listed. A
    segment of lines ends with what isn't passed over, so each belongs to one heading at most: windows and one aggregate.
    """
    w = W.partitionBy(*keys).orderBy("new_line")
    rows = ops.where("op = 'added'").select(*keys, "new_line", "is_header", F.trim(F.regexp_replace("content", r"\s", " ")).alias("__t"), F.col("content").rlike(wrapper).alias("__wrap"))
    rows = rows.withColumn("__gap", F.coalesce(F.col("new_line") - F.lag("new_line").over(w) != 1, F.lit(True)))
    blank, after = F.col("__t") == "", (F.lead("__t").over(w) == "") & (F.lead("new_line").over(w) == F.col("new_line") + 1)
    rows = rows.withColumn("__ends", ~(blank | F.col("__wrap")) | F.coalesce(blank & after, F.lit(False)))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    segment = F.sum(F.col("__gap").cast("int")).over(w) + F.coalesce(F.sum(F.col("__ends").cast("int")).over(before), F.lit(0))
    per = rows.withColumn("__s", segment).groupBy(*keys, "__s").agg(
        F.max(F.when(F.col("is_header"), F.col("new_line"))).alias("heading_line"), F.min(F.when(F.col("__wrap"), F.col("new_line"))).alias("first_line"), (F.count(F.lit(1)) - 1).alias("n_ignored"))
    return per.where("heading_line IS NOT NULL AND first_line IS NOT NULL").select(*keys, "heading_line", "first_line", (F.col("heading_line") - F.col("first_line")).alias("n_lines"), "n_ignored")
