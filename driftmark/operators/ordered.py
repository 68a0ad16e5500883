"""Order-dependent steps within one document, in Arrow batches grouped by document.

IDs: DIF2 DIF3 DIF8 DIF13 DIF18 DIF21 JOIN6 JOIN7 JOIN9 SEQ4 SC12 SC13 FLT16 FLT20 JS3. A group is the headings or lines of one
file, so it is bounded by a file; nothing here groups by anything larger.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.runtime import ship


def snapshot_diff(rows: DataFrame, base: str, head: str, context: int = 3) -> DataFrame:
    """Adds ``patch``, ``additions`` and ``deletions`` between two texts after line ends are made alike; null counts as empty, no change as an empty patch."""
    ship(rows.sparkSession)

    @F.pandas_udf("patch string, additions int, deletions int")
    def diff(a, b):
        import difflib

        import pandas as pd

        out = []
        for x, y in zip(a, b):
            x, y = (("" if t is None else t).replace("\r\n", "\n").replace("\r", "\n").split("\n") for t in (x, y))
            lines = list(difflib.unified_diff(x, y, n=context, lineterm=""))[2:]
            out.append(("\n".join(lines), sum(v.startswith("+") for v in lines), sum(v.startswith("-") for v in lines)))
        return pd.DataFrame(out, columns=["patch", "additions", "deletions"])

    return rows.withColumn("__d", diff(F.col(base), F.col(head))).select(*rows.columns, "__d.patch", "__d.additions", "__d.deletions")


def pair_headings(ops: DataFrame, keys: list[str], near: int = 5, far: int = 20, alike: float = 0.6) -> DataFrame:
    """Deleted headings paired with added ones, first fit in order: within ``near`` lines of the diff, or alike and within ``far``.

    ``old_line``, ``new_line``, ``old``, ``new`` and ``similarity`` of the titles. Each heading is in one pair at most.
    """
    ship(ops.sparkSession)
    heads = ops.where("is_header AND op IN ('added', 'deleted')").select(*keys, "diff_index", "op", "old_line", "new_line", "content")
    schema = ", ".join(f"{k} {heads.schema[k].dataType.simpleString()}" for k in keys) + ", old_line int, new_line int, old string, new string, similarity double"

    def pair(key, pdf):
        import difflib

        import pandas as pd

        gone = pdf[pdf.op == "deleted"].sort_values("diff_index")
        new = pdf[pdf.op == "added"].sort_values("diff_index").to_dict("records")
        out = []
        for g in gone.to_dict("records"):
            for n in new:
                gap = abs(n["diff_index"] - g["diff_index"])
                if gap > max(near, far):
                    continue
                ratio = difflib.SequenceMatcher(None, g["content"].lstrip("# "), n["content"].lstrip("# ")).ratio()
                if gap <= near or ratio >= alike:
                    out.append((*key, int(g["old_line"]), int(n["new_line"]), g["content"], n["content"], ratio))
                    new.remove(n)
                    break
        return pd.DataFrame(out, columns=[*keys, "old_line", "new_line", "old", "new", "similarity"])

    return heads.groupBy(*keys).applyInPandas(pair, schema)


def forward_greedy(left: DataFrame, right: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """In order, each left row takes the next unused right row of equal value after the last one taken, else the first unused before it."""
    ship(left.sparkSession)
    both = left.select(*keys, F.col(value).alias("v"), F.col(pos).alias("p"), F.lit(0).alias("side")).unionByName(right.select(*keys, F.col(value).alias("v"), F.col(pos).alias("p"), F.lit(1).alias("side")))
    schema = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in keys) + ", left_pos bigint, right_pos bigint"

    def walk(key, pdf):
        import pandas as pd

        unused: dict = {}
        for v, p in pdf[pdf.side == 1].sort_values("p")[["v", "p"]].itertuples(index=False):
            unused.setdefault(v, []).append(p)
        out, at = [], -1
        for v, p in pdf[(pdf.side == 0) & pdf.v.notna()].sort_values("p")[["v", "p"]].itertuples(index=False):
            left_over = unused.get(v)
            if left_over:
                at = next((q for q in left_over if q > at), left_over[0])
                left_over.remove(at)
                out.append((*key, int(p), int(at)))
        return pd.DataFrame(out, columns=[*keys, "left_pos", "right_pos"])

    return both.groupBy(*keys).applyInPandas(walk, schema)


def exact_else_within(left: DataFrame, right: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Left rows with the first right row of equal value, else the first whose value contains it or lies within it; ``how`` is exact or within."""
    have = right.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("r"))
    a = left.where(F.col(value).isNotNull() & (F.col(value) != "")).join(have, keys)
    same = F.get(F.filter("r", lambda x: x["v"] == F.col(value)), F.lit(0))["p"]
    part = F.get(F.filter("r", lambda x: F.contains(x["v"], F.col(value)) | F.contains(F.col(value), x["v"])), F.lit(0))["p"]
    return a.select(*keys, F.col(pos).alias("left_pos"), F.coalesce(same, part).alias("right_pos"), F.when(same.isNotNull(), "exact").otherwise("within").alias("how")).where("right_pos IS NOT NULL")


def without_sections(lines: DataFrame, keys: list[str], titles: list[str]) -> DataFrame:
    """Lines outside the sections with one of the titles; a section reaches to the next heading of its rank or higher."""
    wanted = [t.strip().lower() for t in titles]
    w = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    title = F.lower(F.trim(F.regexp_replace("text", r"^#+\s*", "")))
    rows = lines.withColumn("__cut", F.when(F.col("level") > 0, F.when(title.isin(wanted), F.col("level")).otherwise(0)))
    # A fold over the headings only: inside a cut section of rank r until a heading of rank r or above that isn't one itself.
    heads = rows.where("level > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "level", "__cut"))).alias("h"))
    fold = ("aggregate(h, named_struct('r', 0, 'o', CAST(array() AS array<struct<n:int,c:boolean>>)), (a, x) -> named_struct("
            "'r', CASE WHEN a.r > 0 AND x.level > a.r THEN a.r WHEN x.__cut > 0 THEN x.__cut ELSE 0 END, "
            "'o', concat(a.o, array(named_struct('n', x.line_no, 'c', (a.r > 0 AND x.level > a.r) OR x.__cut > 0)))), a -> a.o)")
    marks = heads.select(*keys, F.explode(F.expr(fold)).alias("m")).select(*keys, F.col("m.n").alias("line_no"), F.col("m.c").alias("__in"))
    out = rows.join(marks, [*keys, "line_no"], "left").withColumn("__in", F.coalesce(F.last("__in", ignorenulls=True).over(w), F.lit(False)))
    return out.where("NOT __in").drop("__in", "__cut")


def section_changes(base: DataFrame, head: DataFrame, keys: list[str], path: str, content: str) -> DataFrame:
    """Sections by hierarchy path and occurrence: ``operation`` added, deleted or modified; equal ones, but for blanks at the end, are left out."""
    from driftmark.operators.reports import keyed_changes

    nth = F.row_number().over(W.partitionBy(*keys, path).orderBy("section_line"))

    def prepared(df: DataFrame) -> DataFrame:
        return df.select(*keys, path, nth.alias("nth"), F.regexp_replace(content, r"\s+$", "").alias("c"))

    return keyed_changes(prepared(base), prepared(head), [*keys, path, "nth"], "c").withColumnRenamed("change", "operation")


def repaired_levels(target: DataFrame, source: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Headings of the target with ``level`` taken from the source heading at the same place, where both have as many headings."""
    from driftmark.operators.matching import zip_positions

    size = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    same = size(target, "a").join(size(source, "b"), keys).where("a = b").select(*keys)
    return zip_positions(target.select(*keys, pos, "level"), source.select(*keys, pos, "level"), keys, pos).join(same, keys, "left_semi").select(
        *keys, F.col(f"left_{pos}").alias(pos), F.col("left_level").alias("old_level"), F.col("right_level").alias("level"))


def json_prefix(reply: Column) -> Column:
    """A JSON object of strings cut off in transfer, as a map of the members that are whole; null where none is."""
    @F.pandas_udf("map<string,string>")
    def parse(replies):
        import pandas as pd

        def one(t):
            if t is None or "{" not in t:
                return None
            t = t[t.index("{"):]
            for end in [len(t), *(i for i in range(len(t) - 1, 0, -1) if t[i] == '"')]:
                for tail in ("", "}", '"}'):
                    try:
                        v = json.loads(t[:end + (end < len(t))] + tail)
                    except ValueError:
                        continue
                    if isinstance(v, dict):
                        return {k: x for k, x in v.items() if isinstance(x, str)}
            return None

        return pd.Series([one(t) for t in replies])

    return parse(reply)
