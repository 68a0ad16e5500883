"""Queries on document structure, over both sides of every page of ``structure_pair``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators import structure as S
from driftmark.runtime import latest_by, table

K = ["pair_id", "side"]


def documents(spark: SparkSession, d: str) -> DataFrame:
    """``pair_id``, ``side`` (source, target) and ``content`` of the latest version of each page."""
    latest = latest_by(table(spark, d, "structure_pair"), ["pair_id"], "loaded_at", ["source_content", "target_content"])
    return latest.select("pair_id", F.explode(F.array(
        F.struct(F.lit("source").alias("side"), F.col("source_content").alias("content")),
        F.struct(F.lit("target").alias("side"), F.col("target_content").alias("content")))).alias("x")).select("pair_id", "x.side", "x.content")


def lines(spark: SparkSession, d: str, fence: str = "run_prefix") -> DataFrame:
    return S.document_lines(documents(spark, d), K, "content", fence)


def _heads(spark: SparkSession, d: str) -> DataFrame:
    return S.headings(lines(spark, d), K)


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy(*K).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("in_fence").alias("n_fenced"), F.count_if(F.col("level") > 0).alias("n_headings"),
        F.sum("level").alias("sum_levels"))


def _dialect(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return lines(spark, d, name).groupBy(*K).agg(F.count_if("in_fence").alias("n_fenced"), F.count_if(F.col("level") > 0).alias("n_headings"))

    return query


def heading_rle(spark: SparkSession, d: str) -> DataFrame:
    return S.heading_runs(_heads(spark, d), K)


def heading_first_diff(spark: SparkSession, d: str) -> DataFrame:
    return S.first_heading_difference(_heads(spark, d), ["pair_id"], "side", "source", "target")


def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return S.hierarchy(_heads(spark, d), K)


def section_end(spark: SparkSession, d: str) -> DataFrame:
    ls = lines(spark, d)
    return S.section_ends(S.headings(ls, K), ls, K)


def section_content(spark: SparkSession, d: str) -> DataFrame:
    return S.section_contents(lines(spark, d), K)


def first_headings(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).groupBy(*K).agg(
        F.min(F.when(F.col("level") == 1, F.col("line_no"))).alias("first_h1"), F.min(F.when(F.col("level") == 2, F.col("line_no"))).alias("first_h2"),
        F.min_by("title", "line_no").alias("first_title"))


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return S.blocks(lines(spark, d), K)


def page_tags(spark: SparkSession, d: str) -> DataFrame:
    return S.tag_balance(S.tags(lines(spark, d), K), K)


def structure_issues(spark: SparkSession, d: str) -> DataFrame:
    return S.structure_issues(lines(spark, d), ["pair_id"], "side", "source", "target")


def line_integrity(spark: SparkSession, d: str) -> DataFrame:
    return S.line_integrity(lines(spark, d), ["pair_id"], "side", "source", "target")


def block_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the target that stand in the source word for word: the nth of equal text takes the nth."""
    from driftmark.operators.matching import multiset_positions

    b = S.blocks(lines(spark, d), K)
    left = b.where("side = 'target'").select("pair_id", "block_no", F.col("content").alias("norm"))
    right = b.where("side = 'source'").select("pair_id", "block_no", F.col("content").alias("norm"))
    return multiset_positions(left, right, ["pair_id"], "norm", "block_no").select("pair_id", F.col("left_pos").alias("target_block"), F.col("right_pos").alias("source_block"))


def overexpansion_cut(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each target up to as many headings as its source has."""
    ls = lines(spark, d)
    n = S.headings(ls, K).where("side = 'source'").groupBy("pair_id").agg(F.count(F.lit(1)).alias("most"))
    kept = S.truncate_at_heading(ls.where("side = 'target'").join(n, "pair_id"), ["pair_id"], F.col("most"))
    return kept.groupBy("pair_id").agg(F.count(F.lit(1)).alias("kept_lines"))


DOCS_SQL = """
WITH docs AS (
  SELECT pair_id, unnest(['source', 'target']) AS side, unnest([source_content, target_content]) AS content FROM (
    SELECT * FROM structure_pair QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC NULLS LAST, source_content DESC NULLS LAST, target_content DESC NULLS LAST) = 1)),
arr AS (SELECT pair_id, side, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS a FROM docs WHERE content IS NOT NULL),
ln AS (SELECT pair_id, side, unnest(range(1, len(a) + 1))::INT AS line_no, unnest(a) AS text FROM arr),
"""


def fenced_sql(mark: str = r"^\s*(`{3,}|~{3,})", closes: str = "starts_with(x.run, acc.run)") -> str:
    """CTEs up to ``lines`` (pair_id, side, line_no, text, in_fence, level): fences folded over the fence lines in order."""
    return DOCS_SQL + f"""
mk AS (SELECT pair_id, side, list({{'n': line_no, 'run': regexp_extract(text, '{mark}', 1), 'bare': regexp_matches(text, '^ {{0,3}}(`+|~+)[ \\t]*$')}} ORDER BY line_no) AS f
       FROM ln WHERE regexp_matches(text, '{mark}') GROUP BY pair_id, side),
sp AS (SELECT pair_id, side, list_reduce(f, lambda acc, x: CASE
         WHEN acc.n = 0 THEN {{'n': x.n, 'run': x.run, 'bare': false, 's': acc.s}}
         WHEN {closes} THEN {{'n': 0, 'run': '', 'bare': false, 's': list_append(acc.s, {{'a': acc.n, 'b': x.n}})}}
         ELSE acc END, {{'n': 0, 'run': '', 'bare': false, 's': []::STRUCT(a INT, b INT)[]}}) AS r FROM (
           SELECT pair_id, side, list_transform(f, lambda x: {{'n': x.n, 'run': x.run, 'bare': x.bare, 's': []::STRUCT(a INT, b INT)[]}}) AS f FROM mk)),
iv AS (SELECT pair_id, side, unnest(r.s) AS v FROM sp UNION ALL SELECT pair_id, side, {{'a': r.n, 'b': 2147483647}} FROM sp WHERE r.n > 0),
st AS (SELECT l.*, EXISTS (SELECT 1 FROM iv WHERE iv.pair_id = l.pair_id AND iv.side = l.side AND l.line_no BETWEEN iv.v.a AND iv.v.b) AS in_fence FROM ln l),
lines AS (SELECT *, CASE WHEN in_fence THEN 0 ELSE length(regexp_extract(text, '^(#{{1,10}})\\s+\\S', 1)) END AS level FROM st),
heads AS (SELECT pair_id, side, line_no, level, row_number() OVER (PARTITION BY pair_id, side ORDER BY line_no) AS pos,
          trim(regexp_replace(text, '^ {{0,3}}#+\\s*', '')) AS title FROM lines WHERE level > 0)
"""


BASE = fenced_sql()
_DIALECTS = {
    "run_prefix": "starts_with(x.run, acc.run)", "first_three": "left(x.run, 3) = left(acc.run, 3)",
    "commonmark": "left(x.run, 1) = left(acc.run, 1) AND length(x.run) >= length(acc.run) AND x.bare", "backtick_toggle": "true", "any_toggle": "true",
    "char_length": "left(x.run, 1) = left(acc.run, 1) AND length(x.run) >= length(acc.run)",
}
_MARK = {"commonmark": "^ {0,3}(`{3,}|~{3,})", "backtick_toggle": r"^\s*(`{3,})"}
_RLE = """, rle AS (SELECT pair_id, side, string_agg(repeat('#', level::INT) || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, ' -> ' ORDER BY g) AS compact FROM (
  SELECT pair_id, side, g, level, count(*) AS n FROM (
    SELECT *, sum(b) OVER (PARTITION BY pair_id, side ORDER BY pos) AS g FROM (
      SELECT *, CASE WHEN coalesce(lag(level) OVER (PARTITION BY pair_id, side ORDER BY pos), 0) <> level THEN 1 ELSE 0 END AS b FROM heads)) GROUP BY ALL) GROUP BY pair_id, side)"""
_TAGS = r""", tg AS (SELECT pair_id, side, line_no, row_number() OVER (PARTITION BY pair_id, side ORDER BY line_no, k) AS pos, tag, CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END AS step FROM (
  SELECT pair_id, side, line_no, unnest(range(len(t))) AS k, regexp_replace(unnest(t), '\s+', ' ', 'g') AS tag FROM (
    SELECT *, regexp_extract_all(text, '</?CustomContent\b[^>]*>') AS t FROM lines WHERE NOT in_fence) WHERE len(t) > 0)),
dp AS (SELECT *, sum(step) OVER (PARTITION BY pair_id, side ORDER BY pos) AS depth FROM tg),
op AS (SELECT *, step = 1 AND min(depth) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= depth AS o FROM dp),
tb AS (SELECT pair_id, side, count(*) AS n_tags, string_agg(tag, ' ' ORDER BY pos) AS signature, min(line_no) FILTER (depth < 0) AS unopened, max(line_no) FILTER (o) AS unclosed FROM op GROUP BY pair_id, side)"""
_BLOCKS = """, bl AS (SELECT pair_id, side, block_no, min(line_no) AS first_line, max(line_no) AS last_line, min(section_no) AS section_no, string_agg(text, chr(10) ORDER BY line_no) AS content FROM (
  SELECT *, sum(begins) OVER w AS block_no, sum(head) OVER w AS section_no FROM (
    SELECT *, (level > 0)::INT AS head, (filled AND NOT coalesce(lag(filled) OVER (PARTITION BY pair_id, side ORDER BY line_no), false))::INT AS begins FROM (
      SELECT *, in_fence OR trim(text) <> '' AS filled FROM lines)) WINDOW w AS (PARTITION BY pair_id, side ORDER BY line_no)) WHERE filled GROUP BY pair_id, side, block_no)"""
_PATHS = "SELECT h.pair_id, h.side, h.line_no, h.level, " + "concat_ws(' > ', " + ", ".join(
    f"(SELECT max_by(repeat('#', a.level::INT) || ' ' || a.title, a.line_no) FROM heads a WHERE a.pair_id = h.pair_id AND a.side = h.side AND a.level = {k} AND h.level > {k} AND a.line_no < h.line_no "
    f"AND NOT EXISTS (SELECT 1 FROM heads b WHERE b.pair_id = h.pair_id AND b.side = h.side AND b.level < {k} AND b.line_no > a.line_no AND b.line_no < h.line_no))" for k in range(2, 7)
) + ", repeat('#', h.level::INT) || ' ' || h.title) AS path FROM heads h"

QUERIES = {
    "page_lines": page_lines, "heading_rle": heading_rle, "heading_first_diff": heading_first_diff, "heading_paths": heading_paths, "section_end": section_end,
    "section_content": section_content, "first_headings": first_headings, "page_blocks": page_blocks, "page_tags": page_tags, "structure_issues": structure_issues,
    "line_integrity": line_integrity, "block_reuse": block_reuse, "overexpansion_cut": overexpansion_cut, **{f"fence_{k}": _dialect(k) for k in S.FENCES},
}
SQL = {
    "page_lines": BASE + "SELECT pair_id, side, count(*) AS n_lines, count(*) FILTER (in_fence) AS n_fenced, count(*) FILTER (level > 0) AS n_headings, sum(level)::BIGINT AS sum_levels FROM lines GROUP BY ALL",
    "heading_rle": BASE + _RLE + "SELECT pair_id, side, compact FROM rle",
    "heading_first_diff": BASE + """, both_sides AS (SELECT pair_id, pos, max(level) FILTER (side = 'source') AS left_level, max(level) FILTER (side = 'target') AS right_level FROM heads GROUP BY ALL)
      SELECT * FROM both_sides WHERE left_level IS DISTINCT FROM right_level QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY pos) = 1""",
    "heading_paths": BASE + _PATHS,
    "section_end": BASE + """SELECT h.pair_id, h.side, h.line_no, h.level,
      coalesce((SELECT min(b.line_no) FROM heads b WHERE b.pair_id = h.pair_id AND b.side = h.side AND b.line_no > h.line_no) - 1, n) AS direct_end,
      coalesce((SELECT min(b.line_no) FROM heads b WHERE b.pair_id = h.pair_id AND b.side = h.side AND b.line_no > h.line_no AND (h.level = 1 OR b.level <= h.level)) - 1, n) AS full_end
      FROM heads h JOIN (SELECT pair_id, side, max(line_no) AS n FROM lines GROUP BY ALL) USING (pair_id, side)""",
    "section_content": BASE + r"""SELECT pair_id, side, section_line, count(*) AS n_lines, string_agg(regexp_replace(text, '\s+$', ''), chr(10) ORDER BY line_no) AS content FROM (
      SELECT *, coalesce(max(CASE WHEN level > 0 THEN line_no END) OVER (PARTITION BY pair_id, side ORDER BY line_no), 0) AS section_line FROM lines) GROUP BY pair_id, side, section_line""",
    "first_headings": BASE + "SELECT pair_id, side, min(line_no) FILTER (level = 1) AS first_h1, min(line_no) FILTER (level = 2) AS first_h2, min_by(title, line_no) AS first_title FROM heads GROUP BY ALL",
    "page_blocks": BASE + _BLOCKS + "SELECT * FROM bl",
    "page_tags": BASE + _TAGS + "SELECT pair_id, side, n_tags, signature, CASE WHEN unopened IS NOT NULL THEN 'unopened' WHEN unclosed IS NOT NULL THEN 'unclosed' END AS problem, coalesce(unopened, unclosed) AS problem_line FROM tb",
    "structure_issues": BASE + _RLE + _TAGS + """, c AS (SELECT pair_id, side, 'heading_order' AS reason, compact AS c FROM rle UNION ALL SELECT pair_id, side, 'content_tags', signature FROM tb)
      SELECT pair_id, reason, max(c) FILTER (side = 'source') AS left_compact, max(c) FILTER (side = 'target') AS right_compact FROM c
      WHERE pair_id IN (SELECT pair_id FROM docs WHERE content IS NOT NULL GROUP BY pair_id HAVING count(*) = 2) GROUP BY pair_id, reason
      HAVING max(c) FILTER (side = 'source') IS DISTINCT FROM max(c) FILTER (side = 'target')""",
    "line_integrity": BASE + """SELECT pair_id, count(*) FILTER (side = 'source') AS left_lines, count(*) FILTER (side = 'target') AS right_lines,
      count(*) FILTER (side = 'source') = count(*) FILTER (side = 'target') AS total_lines_match,
      coalesce(list(line_no ORDER BY line_no) FILTER (side = 'source' AND level > 0), []) = coalesce(list(line_no ORDER BY line_no) FILTER (side = 'target' AND level > 0), []) AS heading_lines_match
      FROM lines GROUP BY pair_id HAVING count(*) FILTER (side = 'source') > 0 AND count(*) FILTER (side = 'target') > 0""",
    "block_reuse": BASE + _BLOCKS + """, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, content ORDER BY block_no) AS rn FROM bl)
      SELECT t.pair_id, t.block_no AS target_block, s.block_no AS source_block FROM r t LEFT JOIN r s ON s.pair_id = t.pair_id AND s.content = t.content AND s.rn = t.rn AND s.side = 'source' WHERE t.side = 'target'""",
    "overexpansion_cut": BASE + """, m AS (SELECT pair_id, count(*) AS most FROM heads WHERE side = 'source' GROUP BY pair_id)
      SELECT pair_id, count(*) AS kept_lines FROM (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY pair_id ORDER BY line_no) AS k FROM lines WHERE side = 'target') JOIN m USING (pair_id) WHERE k <= most GROUP BY pair_id""",
    **{f"fence_{k}": fenced_sql(_MARK.get(k, r"^\s*(`{3,}|~{3,})"), c) + "SELECT pair_id, side, count(*) FILTER (in_fence) AS n_fenced, count(*) FILTER (level > 0) AS n_headings FROM lines GROUP BY ALL" for k, c in _DIALECTS.items()},
}
