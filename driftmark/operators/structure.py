"""Lines, fences, headings, sections, blocks and tags of Markdown documents.

IDs: D4 D6 D11 STR1-STR11 STR16 AGG5 SC13 SC14 VAL1-VAL5. A document is a row with key columns and a text.
Fence state is folded over the fence lines of a document only, a handful, inside one expression;
everything else is windows partitioned by document. Long documents therefore cost no quadratic work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Named fence dialects: (pattern of a fence line with the run as group 1, SQL for "line m closes the fence opened by o").
FENCES = {
    "run_prefix": (r"^\s*(`{3,}|~{3,})", "startswith(m.run, o.run)"),
    "first_three": (r"^\s*(`{3,}|~{3,})", "left(m.run, 3) = left(o.run, 3)"),
    "commonmark": (r"^ {0,3}(`{3,}|~{3,})", "left(m.run, 1) = left(o.run, 1) AND length(m.run) >= length(o.run) AND m.bare"),
    "backtick_toggle": (r"^\s*(`{3,})", "true"),
    "any_toggle": (r"^\s*(`{3,}|~{3,})", "true"),
    "char_length": (r"^\s*(`{3,}|~{3,})", "left(m.run, 1) = left(o.run, 1) AND length(m.run) >= length(o.run)"),
}

#: Named heading dialects: pattern with the run of # as group 1.
HEADINGS = {
    "ten_levels": r"^(#{1,10})\s+\S", "indented": r"^ {0,3}(#{1,6})[ \t]+", "six_levels": r"^(#{1,6})\s+", "indented_text": r"^\s{0,3}(#{1,6})\s+\S",
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def split_lines(content: Column) -> Column:
    """Lines by any line end; a last empty one is kept. Null stays null."""
    return F.split(F.regexp_replace(content, r"\r\n|\r", "\n"), "\n", -1)


def document_lines(docs: DataFrame, keys: list[str], text: str, fence: str = "run_prefix", heading: str = "ten_levels") -> DataFrame:
    """``keys``, ``line_no`` (from 1), ``text``, ``fence_line``, ``in_fence`` (fence lines included), ``level`` (0: no heading).

    Null texts have no lines, empty ones have one. An unclosed fence reaches to the end. No shuffle.
    """
    pattern, closes = FENCES[fence]
    rows = docs.select(*keys, split_lines(F.col(text)).alias("__l")).where("__l IS NOT NULL")
    marks = (
        f"filter(transform(__l, (x, i) -> named_struct('n', i + 1, 'run', regexp_extract(x, {_q(pattern)}, 1), "
        f"'bare', x RLIKE {_q(r'^[ ]{0,3}(?:`+|~+)[ \t]*$')})), m -> m.run != '')"
    )
    none = "named_struct('n', 0, 'run', '', 'bare', false)"
    spans = (
        f"aggregate(__m, named_struct('o', {none}, 's', CAST(array() AS array<struct<a:int,b:int>>)), (acc, m) -> "
        f"CASE WHEN acc.o.n = 0 THEN named_struct('o', m, 's', acc.s) "
        f"WHEN {closes.replace('o.run', 'acc.o.run')} THEN named_struct('o', {none}, 's', concat(acc.s, array(named_struct('a', acc.o.n, 'b', m.n)))) "
        f"ELSE acc END, acc -> CASE WHEN acc.o.n = 0 THEN acc.s ELSE concat(acc.s, array(named_struct('a', acc.o.n, 'b', 2147483647))) END)"
    )
    lines = rows.withColumn("__m", F.expr(marks)).withColumn("__s", F.expr(spans)).select(*keys, "__s", F.posexplode("__l").alias("__i", "text"))
    out = lines.select(
        *keys, (F.col("__i") + 1).alias("line_no"), "text",
        F.expr(f"text RLIKE {_q(pattern)}").alias("fence_line"), F.expr("exists(__s, s -> __i + 1 BETWEEN s.a AND s.b)").alias("in_fence"))
    return out.withColumn("level", F.when(F.col("in_fence"), 0).otherwise(F.length(F.regexp_extract("text", HEADINGS[heading], 1))))


def headings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The heading lines with their ``pos`` in the document (from 1) and ``title``."""
    pos = F.row_number().over(W.partitionBy(*keys).orderBy("line_no"))
    return lines.where("level > 0").select(*keys, "line_no", "level", pos.alias("pos"), F.trim(F.regexp_replace("text", r"^ {0,3}#+\s*", "")).alias("title"))


def heading_runs(heads: DataFrame, keys: list[str]) -> DataFrame:
    """Run-length rendering of each document's heading levels: ``compact`` such as ``# -> ##x2``."""
    w = W.partitionBy(*keys).orderBy("pos")
    start = (F.coalesce(F.lag("level").over(w), F.lit(0)) != F.col("level")).cast("int")
    runs = heads.withColumn("start", start).withColumn("run", F.sum("start").over(w)).groupBy(*keys, "run", "level").agg(F.count(F.lit(1)).alias("n"))
    part = F.concat(F.repeat(F.lit("#"), F.col("level")), F.when(F.col("n") > 1, F.concat(F.lit("x"), F.col("n").cast("string"))).otherwise(""))
    ordered = runs.withColumn("p", part).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "p"))).alias("r"))
    return ordered.select(*keys, F.array_join(F.transform("r", lambda x: x["p"]), " -> ").alias("compact"))


def first_heading_difference(heads: DataFrame, keys: list[str], side: str, left: str, right: str) -> DataFrame:
    """The first ``pos`` at which the level sequences of two sides differ, with both levels (null: none there).

    Both sides meet in one group by key and position, so no join is needed.
    """
    both = heads.groupBy(*keys, "pos").agg(
        F.max(F.when(F.col(side) == left, F.col("level"))).alias("left_level"), F.max(F.when(F.col(side) == right, F.col("level"))).alias("right_level"))
    differ = both.where(~F.col("left_level").eqNullSafe(F.col("right_level")))
    return differ.groupBy(*keys).agg(F.min(F.struct("pos", "left_level", "right_level")).alias("__first")).select(
        *keys, "__first.pos", "__first.left_level", "__first.right_level")


def hierarchy(heads: DataFrame, keys: list[str], levels: int = 10) -> DataFrame:
    """``path``: titles of the ancestors and of the heading itself, joined by `` > ``; level 1 is in no path but its own.

    The latest heading of level k above a heading is its ancestor if no heading of a lesser level came since.
    """
    w = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    # Only the last heading of each level is kept while a document is read, whatever its length.
    own = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"))
    out = heads.withColumn("own", own)
    for k in range(1, levels):
        out = out.withColumn(f"l{k}", F.last(F.when(F.col("level") == k, F.struct("line_no", "own")), ignorenulls=True).over(w))
    parts = []
    for k in range(2, levels):
        lower = F.greatest(F.lit(0), *[F.coalesce(F.col(f"l{j}.line_no"), F.lit(0)) for j in range(1, k)])
        parts.append(F.when((F.col("level") > k) & (F.col(f"l{k}.line_no") > lower), F.col(f"l{k}.own")))
    return out.select(*keys, "line_no", "level", F.concat_ws(" > ", *parts, "own").alias("path"))


def section_ends(heads: DataFrame, lines: DataFrame, keys: list[str], levels: int = 10) -> DataFrame:
    """``direct_end`` (last line before the next heading) and ``full_end`` (before the next of the same or a higher rank); level 1 stops at any heading."""
    after = W.partitionBy(*keys).orderBy("line_no").rowsBetween(1, W.unboundedFollowing)
    size = lines.groupBy(*keys).agg(F.max("line_no").alias("n_lines"))
    nxt = F.min("line_no").over(after)
    full = F.when(F.col("level") == 1, nxt)
    for k in range(2, levels + 1):
        full = full.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(after))
    ends = heads.withColumn("nxt", nxt).withColumn("full", full).join(size, keys)
    return ends.select(*keys, "line_no", "level", F.coalesce(F.col("nxt") - 1, "n_lines").alias("direct_end"), F.coalesce(F.col("full") - 1, "n_lines").alias("full_end"))


def with_section(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each line with ``section_line``, the heading line it stands under (0 before the first): a backward as-of lookup as one window."""
    w = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section_line", F.coalesce(F.last(F.when(F.col("level") > 0, F.col("line_no")), ignorenulls=True).over(w), F.lit(0)))


def section_contents(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Direct content per section: ``section_line``, ``n_lines`` and ``content``, lines right-stripped, in order."""
    rows = with_section(lines, keys).withColumn("t", F.regexp_replace("text", r"\s+$", ""))
    return rows.groupBy(*keys, "section_line").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", "t"))).alias("r")).select(
        *keys, "section_line", "n_lines", F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("content"))


def blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks parted by blank lines, fences whole: ``block_no``, ``first_line``, ``last_line``, ``section_no`` and ``content``."""
    w = W.partitionBy(*keys).orderBy("line_no")
    filled = F.col("in_fence") | (F.trim("text") != "")
    rows = lines.withColumn("filled", filled).withColumn("head", (F.col("level") > 0).cast("int"))
    rows = rows.withColumn("begins", (F.col("filled") & ~F.coalesce(F.lag("filled").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("block_no", F.sum("begins").over(w)).withColumn("section_no", F.sum("head").over(w)).where("filled")
    return rows.groupBy(*keys, "block_no").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min("section_no").alias("section_no"),
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("r")).select(
        *keys, "block_no", "first_line", "last_line", "section_no", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("content"))


TAG = r"</?CustomContent\b[^>]*>"


def tags(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Custom tags outside fences in order: ``pos``, ``line_no``, ``tag``, ``step`` (+1 opens, -1 closes)."""
    found = lines.where(~F.col("in_fence")).select(*keys, "line_no", F.posexplode(F.expr(f"regexp_extract_all(text, {_q(TAG)}, 0)")).alias("k", "tag"))
    pos = F.row_number().over(W.partitionBy(*keys).orderBy("line_no", "k"))
    return found.select(*keys, pos.alias("pos"), "line_no", F.regexp_replace("tag", r"\s+", " ").alias("tag"), F.when(F.col("tag").startswith("</"), -1).otherwise(1).alias("step"))


def tag_balance(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per document with tags: ``n_tags``, ``signature``, and ``problem``: ``unopened``, ``unclosed`` or null, with its ``problem_line``."""
    w = W.partitionBy(*keys).orderBy("pos")
    depth = found.withColumn("depth", F.sum("step").over(w))
    least = F.min("depth").over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    depth = depth.withColumn("open", (F.col("step") == 1) & (least >= F.col("depth")))
    per = depth.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tags"), F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("r"),
        F.min(F.when(F.col("depth") < 0, F.col("line_no"))).alias("unopened"), F.max(F.when(F.col("open"), F.col("line_no"))).alias("unclosed"))
    return per.select(
        *keys, "n_tags", F.array_join(F.transform("r", lambda x: x["tag"]), " ").alias("signature"),
        F.when(F.col("unopened").isNotNull(), "unopened").when(F.col("unclosed").isNotNull(), "unclosed").alias("problem"),
        F.coalesce("unopened", "unclosed").alias("problem_line"))


def structure_issues(lines: DataFrame, keys: list[str], side: str, left: str, right: str) -> DataFrame:
    """Documents of two sides whose heading levels or tags differ: ``reason``, ``left_compact``, ``right_compact``. One side missing is no issue of these kinds."""
    both = [*keys, side]
    runs = heading_runs(headings(lines, both), both).select(*both, F.lit("heading_order").alias("reason"), F.col("compact").alias("c"))
    signs = tag_balance(tags(lines, both), both).select(*both, F.lit("content_tags").alias("reason"), F.col("signature").alias("c"))
    present = lines.select(*both).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(*keys)
    pairs = runs.unionByName(signs).groupBy(*keys, "reason").agg(
        F.max(F.when(F.col(side) == left, F.col("c"))).alias("left_compact"), F.max(F.when(F.col(side) == right, F.col("c"))).alias("right_compact"))
    return pairs.join(present, keys, "left_semi").where(~F.col("left_compact").eqNullSafe(F.col("right_compact")))


def line_integrity(lines: DataFrame, keys: list[str], side: str, left: str, right: str) -> DataFrame:
    """Whether both sides have as many lines and their headings in the same lines; documents with both sides only."""
    per = lines.groupBy(*keys).agg(
        F.count_if(F.col(side) == left).alias("left_lines"), F.count_if(F.col(side) == right).alias("right_lines"),
        F.array_sort(F.collect_list(F.when((F.col(side) == left) & (F.col("level") > 0), F.col("line_no")))).alias("a"),
        F.array_sort(F.collect_list(F.when((F.col(side) == right) & (F.col("level") > 0), F.col("line_no")))).alias("b")).where("left_lines > 0 AND right_lines > 0")
    return per.select(*keys, "left_lines", "right_lines", (F.col("left_lines") == F.col("right_lines")).alias("total_lines_match"), (F.col("a") == F.col("b")).alias("heading_lines_match"))


def truncate_at_heading(lines: DataFrame, keys: list[str], most: Column) -> DataFrame:
    """Lines before heading number ``most`` + 1 of each document."""
    n = F.sum((F.col("level") > 0).cast("int")).over(W.partitionBy(*keys).orderBy("line_no"))
    return lines.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")
