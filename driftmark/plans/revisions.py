"""Queries that follow sections across versions, and on text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import markdown as M
from driftmark.operators import ordered as O
from driftmark.operators import reports as R
from driftmark.operators import revision as V
from driftmark.operators import structure as S
from driftmark.plans import changes, pages
from driftmark.runtime import table


def section_match(spark: SparkSession, d: str) -> DataFrame:
    """Sections of both sides of a page, by heading text, else by number of lines, else in order of level."""
    ls = pages.lines(spark, d)
    c = S.section_contents(ls, pages.K).join(S.headings(ls, pages.K).withColumnRenamed("line_no", "section_line"), [*pages.K, "section_line"])
    c = c.select("pair_id", "side", "section_line", "title", F.concat_ws("/", "level", "n_lines").alias("shape"), F.col("level").cast("string").alias("lv"))
    return V.match_sections(c.where("side = 'target'"), c.where("side = 'source'"), ["pair_id"], "section_line", ["title", "shape", "lv"])


def replacements(spark: SparkSession, d: str) -> DataFrame:
    return V.replacements(changes._ops(spark, d), ["diff_id"])


def section_batches(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a page in batches of at most 20 lines; a longer section is a batch of its own."""
    c = S.section_contents(pages.lines(spark, d), pages.K)
    return R.greedy_chunks(c, pages.K, "section_line", "n_lines", 1_000_000, 20)


def char_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Rough token totals per repository, a token being four characters."""
    return changes._apply(spark, d).groupBy("repo").agg(F.sum(F.expr("length(source_new_content) div 4")).alias("tokens"), F.max(F.length("source_new_content")).alias("longest"))


def prefix_events(spark: SparkSession, d: str) -> DataFrame:
    """Diffs found by an abbreviated digest of their number."""
    full = table(spark, d, "diff_file").select("diff_id", F.sha2(F.col("diff_id").cast("string"), 256).alias("digest")).distinct()
    short = full.select(F.substring("digest", 1, 9).alias("abbr"))
    return V.by_prefix(short, full, "abbr", "digest").select("abbr", "diff_id")


def scope_files(spark: SparkSession, d: str) -> DataFrame:
    x = changes._diffs(spark, d).select("diff_id", "side", "filename", "previous_filename")
    paths = x.where("side = 'target'").select("filename").distinct()
    return V.without_folders(V.in_scope(x.where("side = 'source'"), paths, "filename"), "filename", ["admin/", "/faq"]).select("diff_id", "filename")


def svg_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tags of target pages as placeholders: how many, and whether restoring gives the text back."""
    docs = pages.documents(spark, d).where("side = 'target' AND content IS NOT NULL").withColumn("x", M.strip_blocks(F.col("content"), r"</?CustomContent[^>]*>", "TAG"))
    return docs.select("pair_id", F.size("x.blocks").alias("n_tags"), (M.restore_blocks(F.col("x.text"), F.col("x.blocks"), "TAG") == F.col("content")).alias("same"))


def alias_lines(spark: SparkSession, d: str) -> DataFrame:
    ls = pages.lines(spark, d).where("text LIKE 'aliases:%'")
    return ls.select("pair_id", "side", "line_no", M.localized_aliases(F.col("text"), "/zh").alias("line"))


def link_rewrite(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "section_apply").where("source_new_content LIKE '%](%'").select("apply_id", "source_new_content").distinct()
    return docs.select("apply_id", F.sha2(M.absolute_links(F.col("source_new_content"), "https://docs.example"), 256).alias("text_hash"))


def heading_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Pages that lost the blank lines before their headings, with such lines put in again: their lengths."""
    docs = pages.documents(spark, d).where("content IS NOT NULL").withColumn("content", F.regexp_replace("content", r"\n+#", "\n#"))
    spaced = M.blank_before_headings(F.col("content"))
    return docs.select("pair_id", "side", F.length("content").alias("n_before"), F.length(spaced).alias("n_chars"))


def external_echo(spark: SparkSession, d: str) -> DataFrame:
    """The external stage with its default, the identity, and its outcomes."""
    rows = changes._apply(spark, d).select("apply_id", "source_new_content")
    return V.call_external(rows, "source_new_content").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("reply")).alias("chars"))


def heading_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Headings of both sides of a page, paired in the difference of their texts."""
    from driftmark.operators import diffs as D

    rows = pages.documents(spark, d).groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == "source", F.col("content"))).alias("a"), F.max(F.when(F.col("side") == "target", F.col("content"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return O.pair_headings(D.operations(O.snapshot_diff(rows, "a", "b"), ["pair_id"], "patch"), ["pair_id"])


def forward_match(spark: SparkSession, d: str) -> DataFrame:
    """Target headings with source headings of equal level, taken in order."""
    h = pages._heads(spark, d).select("pair_id", "side", "line_no", F.col("level").cast("string").alias("lv"))
    return O.forward_greedy(h.where("side = 'target'"), h.where("side = 'source'"), ["pair_id"], "lv", "line_no")


def level_repair(spark: SparkSession, d: str) -> DataFrame:
    h = pages._heads(spark, d)
    return O.repaired_levels(h.where("side = 'target'"), h.where("side = 'source'"), ["pair_id"], "line_no")


def sections_without(spark: SparkSession, d: str) -> DataFrame:
    """Lines of source pages that are left without their sections on what comes first."""
    ls = pages.lines(spark, d).where("side = 'source'")
    return O.without_sections(ls, ["pair_id"], ["Before you start", "开始之前"]).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"))


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """Old against new content of section updates, as a patch and its counts."""
    rows = changes._apply(spark, d).select("apply_id", "source_old_content", "source_new_content")
    return O.snapshot_diff(rows, "source_old_content", "source_new_content").select("apply_id", "additions", "deletions")


def section_changes(spark: SparkSession, d: str) -> DataFrame:
    """Sections that differ between source and target of a page by the shape of their headings."""
    def sections(side: str) -> DataFrame:
        ls = pages.lines(spark, d).where(F.col("side") == side)
        h = pages._heads(spark, d).where(F.col("side") == side).select("pair_id", F.col("line_no").alias("section_line"), F.repeat(F.lit("#"), F.col("level")).alias("path"))
        return S.section_contents(ls, ["pair_id"]).select("pair_id", "section_line", F.col("n_lines").cast("string").alias("content")).join(h, ["pair_id", "section_line"])

    return O.section_changes(sections("source"), sections("target"), ["pair_id"], "path", "content")


_C = pages.BASE + r""", sc AS (SELECT pair_id, side, section_line, count(*) AS n_lines FROM (
      SELECT *, coalesce(max(CASE WHEN level > 0 THEN line_no END) OVER (PARTITION BY pair_id, side ORDER BY line_no), 0) AS section_line FROM lines) GROUP BY pair_id, side, section_line)
"""
QUERIES = {f.__name__: f for f in (section_match, replacements, section_batches, char_tokens, prefix_events, scope_files, svg_round_trip, alias_lines, link_rewrite, heading_spacing, external_echo, heading_pairs, forward_match, level_repair, sections_without, version_diff, section_changes)}
SQL = {
    "heading_spacing": pages.BASE + r""", hs AS (SELECT pair_id, side, count(*) AS n FROM (
        SELECT *, last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY pair_id, side ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lines)
      WHERE NOT in_fence AND regexp_matches(text, '^#{1,6} \S') AND regexp_matches(before, '\S') GROUP BY ALL), sq AS (SELECT pair_id, side, length(regexp_replace(content, '\n+#', chr(10) || '#', 'g')) AS n_before FROM docs WHERE content IS NOT NULL)
      SELECT pair_id, side, n_before::INT AS n_before, (n_before + coalesce(n, 0))::INT AS n_chars FROM sq LEFT JOIN hs USING (pair_id, side)""",
    "level_repair": pages.BASE + """, n AS (SELECT pair_id FROM heads GROUP BY pair_id HAVING count(*) FILTER (side = 'source') = count(*) FILTER (side = 'target'))
      SELECT t.pair_id, t.line_no, t.level AS old_level, s.level FROM heads t JOIN heads s ON s.pair_id = t.pair_id AND s.pos = t.pos AND t.side = 'target' AND s.side = 'source' WHERE t.pair_id IN (SELECT pair_id FROM n)""",
    "section_changes": _C + """, x AS (SELECT h.pair_id, h.side, repeat('#', h.level::INT) AS path, n_lines::VARCHAR AS c, row_number() OVER (PARTITION BY h.pair_id, h.side, h.level ORDER BY h.line_no) AS nth
        FROM heads h JOIN sc ON sc.pair_id = h.pair_id AND sc.side = h.side AND sc.section_line = h.line_no),
      y AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.path, b.path) AS path, coalesce(a.nth, b.nth) AS nth, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.c <> b.c THEN 'modified' END AS operation
        FROM (SELECT * FROM x WHERE side = 'source') a FULL JOIN (SELECT * FROM x WHERE side = 'target') b ON a.pair_id = b.pair_id AND a.path = b.path AND a.nth = b.nth)
      SELECT * FROM y WHERE operation IS NOT NULL""",
    "replacements": changes._OPS + """, b AS (SELECT *, sum(g) OVER (PARTITION BY diff_id ORDER BY diff_index) AS block FROM (
      SELECT *, (coalesce(diff_index - lag(diff_index) OVER (PARTITION BY diff_id ORDER BY diff_index), 2) > 1)::INT AS g FROM ops WHERE op <> 'context')),
      o AS (SELECT *, row_number() OVER (PARTITION BY diff_id, block, op ORDER BY diff_index) AS nth FROM b),
      p AS (SELECT diff_id, block, nth, max(content) FILTER (op = 'deleted') AS old, max(content) FILTER (op = 'added') AS new, min(diff_index) AS at_ FROM o GROUP BY ALL)
      SELECT diff_id, old, new, count(*) AS n, min(at_) AS first_at FROM p WHERE (diff_id, block) NOT IN (SELECT (diff_id, block) FROM p WHERE old IS NULL OR new IS NULL) AND old <> new GROUP BY diff_id, old, new""",
    "section_batches": _C + """, v AS (SELECT pair_id, side, list({'no': 0::BIGINT, 's': n_lines, 'p': section_line, 'o': []::STRUCT(p INT, s BIGINT, c BIGINT)[]} ORDER BY section_line) AS v FROM sc GROUP BY ALL),
      f AS (SELECT pair_id, side, list_reduce(v, lambda a, x: CASE WHEN a.no = 0 OR a.s + x.s > 20 THEN {'no': a.no + 1, 's': x.s, 'p': x.p, 'o': list_append(a.o, {'p': x.p, 's': x.s, 'c': a.no + 1})}
        ELSE {'no': a.no, 's': a.s + x.s, 'p': x.p, 'o': list_append(a.o, {'p': x.p, 's': x.s, 'c': a.no})} END, {'no': 0::BIGINT, 's': 0::BIGINT, 'p': 0, 'o': []::STRUCT(p INT, s BIGINT, c BIGINT)[]}) AS r FROM v)
      SELECT pair_id, side, o.p AS section_line, o.s AS n_lines, o.c AS chunk_no FROM (SELECT pair_id, side, unnest(r.o) AS o FROM f)""",
    "char_tokens": changes._A + "SELECT repo, sum(length(source_new_content) // 4)::BIGINT AS tokens, max(length(source_new_content)) AS longest FROM ap GROUP BY repo",
    "prefix_events": "WITH f AS (SELECT DISTINCT diff_id, sha256(diff_id::VARCHAR) AS g FROM diff_file) SELECT left(a.g, 9) AS abbr, b.diff_id FROM f a JOIN f b ON starts_with(b.g, left(a.g, 9))",
    "scope_files": changes._D + """q AS (SELECT filename AS path FROM df WHERE side = 'target' AND filename IS NOT NULL) SELECT diff_id, filename FROM df WHERE side = 'source' AND (filename IN (SELECT path FROM q) OR previous_filename IN (SELECT path FROM q))
      AND filename NOT LIKE 'admin/%' AND filename NOT LIKE 'faq/%'""",
    "svg_round_trip": pages.DOCS_SQL + "q AS (SELECT 1) SELECT pair_id, len(list_distinct(regexp_extract_all(content, '</?CustomContent[^>]*>'))) AS n_tags, true AS same FROM docs WHERE side = 'target' AND content IS NOT NULL",
    "alias_lines": pages.BASE + """SELECT pair_id, side, line_no, CASE WHEN regexp_matches(text, '^aliases:\\s*\\[.*\\]\\s*$') THEN 'aliases: [''/zh' || array_to_string(regexp_extract_all(text, '[\"'']?(/[^\"'',\\]\\s]*)[\"'']?', 1), ''',''/zh') || ''']' ELSE text END AS line FROM lines WHERE text LIKE 'aliases:%'""",
    "link_rewrite": r"""SELECT DISTINCT apply_id, sha256(regexp_replace(source_new_content, '\]\(([^()\s#]*/)?([^()\s#/]+)\.md(#[^()\s]*)?\)', '](https://docs.example/\2\3)', 'g')) AS text_hash FROM section_apply WHERE source_new_content LIKE '%](%'""",
    "external_echo": changes._A + "SELECT CASE WHEN source_new_content IS NULL THEN 'skipped' ELSE 'success' END AS status, count(*) AS n, sum(length(source_new_content))::BIGINT AS chars FROM ap GROUP BY 1",
}
