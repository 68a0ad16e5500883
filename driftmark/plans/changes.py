"""Queries on changed files (``diff_file``), section updates (``section_apply``) and file statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.functions import markdown as M
from driftmark.operators import diffs as D
from driftmark.operators import matching as J
from driftmark.operators import reports as R
from driftmark.plans import pages
from driftmark.runtime import latest_by, table

K = ["diff_id"]


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(table(spark, d, "diff_file"), K, "loaded_at", ["sync_id", "side", "filename", "status", "patch", "previous_filename"])


def _ops(spark: SparkSession, d: str) -> DataFrame:
    return D.operations(_diffs(spark, d), K, "patch")


def _apply(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(table(spark, d, "section_apply"), ["apply_id"], "loaded_at", [
        "repo", "path", "section_key", "source_operation", "source_old_content", "source_new_content", "source_original_hierarchy", "target_line", "target_hierarchy"])


def diff_ops(spark: SparkSession, d: str) -> DataFrame:
    return _ops(spark, d)


def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.line_counts(_ops(spark, d), K)


def noop_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.noop_pairs(_ops(spark, d), K)


def changed_ranges(spark: SparkSession, d: str) -> DataFrame:
    return D.changed_ranges(_ops(spark, d), K)


def insertion_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.insertion_groups(_ops(spark, d), K)


def heading_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Added headings with what is added right above them: wrapper lines, and bare fence marks, as these diffs hold no wrappers there."""
    return D.heading_prefixes(_ops(spark, d), K, r"^\s*(?:<CustomContent\b[^>]*>|`{3,})\s*$")


def containing_section(spark: SparkSession, d: str) -> DataFrame:
    return D.containing_sections(D.sides(_ops(spark, d), K), K)


def restructured(spark: SparkSession, d: str) -> DataFrame:
    return D.restructured(D.sides(_ops(spark, d), K), K)


def heading_bags(spark: SparkSession, d: str) -> DataFrame:
    """How the bags of headings of a diff's old and new side overlap."""
    heads = D.sides(_ops(spark, d), K).where("level > 0").withColumn("title", M.clean_title(F.col("text")))
    return J.multiset_overlap(heads.where("ref = 'base'"), heads.where("ref = 'head'"), K, "title")


def reorder_lcs(spark: SparkSession, d: str) -> DataFrame:
    """Headings kept in order against headings kept at all; reordered if fewer."""
    heads = D.sides(_ops(spark, d), K).where("level > 0").withColumn("title", M.clean_title(F.col("text")))

    def ordered(ref: str) -> F.Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("ref") == ref, F.struct("line_no", "title")))), lambda x: x["title"])

    lists = heads.groupBy(*K).agg(ordered("base").alias("a"), ordered("head").alias("b"))
    return D.longest_common(lists, K, "a", "b").join(heading_bags(spark, d).select("diff_id", "common"), K).select("diff_id", "lcs", "common", (F.col("lcs") < F.col("common")).alias("reordered"))


def level_only_changes(spark: SparkSession, d: str) -> DataFrame:
    """Added sections against themselves with the first heading at level 2: which differ in its level alone."""
    rows = _apply(spark, d).where("source_new_content IS NOT NULL").withColumn("moved", M.set_heading_level(F.col("source_new_content"), F.lit(2)))
    return D.level_only_changes(rows, ["apply_id"], "source_new_content", "moved")


def hunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Hunks of source diffs that overlap a changed range of the translated side of the same sync."""
    ops = _ops(spark, d).join(_diffs(spark, d).where("sync_id IS NOT NULL").select("diff_id", "sync_id", "side"), K)
    hunks = ops.where("side = 'source'").groupBy("sync_id", "hunk").agg(F.min("new_line").alias("first_line"), F.max("new_line").alias("last_line"))
    ranges = D.changed_ranges(ops.where("side = 'target'"), ["sync_id"]).select("sync_id", F.col("first_line").alias("start"), F.col("last_line").alias("end"))
    return D.overlapping(hunks, ranges, ["sync_id"])


def file_routing(spark: SparkSession, d: str) -> DataFrame:
    return _diffs(spark, d).select("diff_id", M.processing_type(F.col("filename")).alias("kind"), M.path_key(F.col("filename")).alias("path_key"),
                                   F.coalesce(F.col("previous_filename"), F.col("filename")).alias("old_name"))


def missing_targets(spark: SparkSession, d: str) -> DataFrame:
    """Syncs whose source side has no translated side yet (anti-join)."""
    x = _diffs(spark, d)
    return x.where("side = 'source'").join(x.where("side = 'target'").select("sync_id"), "sync_id", "left_anti").select("sync_id", "diff_id", "status")


def _stats(spark: SparkSession, d: str, system: str) -> DataFrame:
    return latest_by(table(spark, d, f"file_stats_{system}"), ["run_id", "path"], "loaded_at", ["additions", "deletions", "status", "is_md"])


def report_levels(spark: SparkSession, d: str) -> DataFrame:
    return R.report_levels(_stats(spark, d, "replica"), _stats(spark, d, "primary"), ["run_id", "path"], 5)


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return report_levels(spark, d).groupBy("run_id", "level").agg(F.count(F.lit(1)).alias("n"))


def changed_status(spark: SparkSession, d: str) -> DataFrame:
    """Files by presence in two systems: added, deleted or modified status text."""
    return R.keyed_changes(_stats(spark, d, "primary"), _stats(spark, d, "replica"), ["run_id", "path"], "status")


def duplicate_sections(spark: SparkSession, d: str) -> DataFrame:
    """Section keys that a repository has more than once."""
    return _apply(spark, d).groupBy("repo", "section_key").agg(F.count(F.lit(1)).alias("n"), F.min("apply_id").alias("first_id")).where("n > 1")


def operation_counts(spark: SparkSession, d: str) -> DataFrame:
    return _apply(spark, d).groupBy("source_operation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("n_paths"),
                                                             F.sum(F.length("source_new_content")).alias("chars"))


def apply_order(spark: SparkSession, d: str) -> DataFrame:
    return R.apply_order(_apply(spark, d), ["repo", "path"])


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Updates of one file packed in order into chunks of at most 8 sections and 4,000 characters."""
    rows = _apply(spark, d).select("repo", "path", "apply_id", (F.coalesce(F.length("source_new_content"), F.lit(0)) + F.coalesce(F.length("source_old_content"), F.lit(0))).alias("chars"))
    return R.greedy_chunks(rows, ["repo", "path"], "apply_id", "chars", 8, 4000)


def mapping_problems(spark: SparkSession, d: str) -> DataFrame:
    def level(c: str) -> F.Column:
        return F.length(F.regexp_extract(F.element_at(F.split(F.col(c), " > "), -1), r"^(#+)", 1))

    rows = _apply(spark, d).where("source_operation != 'added'").select(
        "repo", "path", "apply_id", F.nullif(F.col("target_line"), F.lit(-1)).alias("target_line"),
        level("source_original_hierarchy").alias("source_level"), level("target_hierarchy").alias("target_level"))
    return R.mapping_problems(rows, ["repo", "path"], "apply_id", "target_line")


def title_clean(spark: SparkSession, d: str) -> DataFrame:
    leaf = F.element_at(F.split(F.col("source_original_hierarchy"), " > "), -1)
    return _apply(spark, d).select("apply_id", M.clean_title(leaf).alias("title"), M.has_cjk(leaf).alias("cjk"))


def anchor_slugs(spark: SparkSession, d: str) -> DataFrame:
    heads = pages._heads(spark, d).where("side = 'source'")
    return heads.select("pair_id", "line_no", M.anchor_slug(F.col("title")).alias("slug"))


def heading_levels_set(spark: SparkSession, d: str) -> DataFrame:
    return _apply(spark, d).where("source_new_content IS NOT NULL").select("apply_id", F.sha2(M.set_heading_level(F.col("source_new_content"), F.lit(4)), 256).alias("text_hash"))


def step_match(spark: SparkSession, d: str) -> DataFrame:
    """Headings of both sides of a page that alone have their level and place among that level."""
    h = pages._heads(spark, d)
    n = F.row_number().over(Window.partitionBy("pair_id", "side", "level").orderBy("line_no"))
    h = h.withColumn("step", n)
    return J.unique_key_join(h.where("side = 'source'"), h.where("side = 'target'"), ["pair_id", "level", "step"], "line_no")


def zip_headings(spark: SparkSession, d: str) -> DataFrame:
    h = pages._heads(spark, d).select("pair_id", "side", "line_no", "level")
    return J.zip_positions(h.where("side = 'source'").drop("side"), h.where("side = 'target'").drop("side"), ["pair_id"], "line_no")


def nearest_line(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a code name of the target, each with the nearest source line that holds the same name."""
    ls = pages.lines(spark, d).where("NOT in_fence").withColumn("name", F.regexp_extract("text", "`([^`]+)`", 1)).where("name != ''")
    return J.nearest(ls.where("side = 'target'"), ls.where("side = 'source'"), ["pair_id"], "name", "line_no").select("pair_id", "name", F.col("left_pos").alias("target_line"), F.col("right_pos").alias("source_line"))


def parent_match(spark: SparkSession, d: str) -> DataFrame:
    """Headings of the target with the source heading of equal level whose two preceding levels agree best."""
    w = Window.partitionBy("pair_id", "side").orderBy("line_no").rowsBetween(-2, -1)
    mark = F.col("level").cast("string")
    heads = pages._heads(spark, d).select("pair_id", "side", "line_no", mark.alias("title"), F.collect_list(mark).over(w).alias("parents"))
    return J.best_by_parents(heads.where("side = 'target'"), heads.where("side = 'source'"), ["pair_id"], "title", "parents", "line_no")


def glossary_match(spark: SparkSession, d: str) -> DataFrame:
    """English source pages with the agreed terms they hold, longest first."""
    rows = [(r.en,) for r in table(spark, d, "glossary").where("en IS NOT NULL").select(F.trim("en").alias("en")).distinct().collect()]
    docs = latest_by(table(spark, d, "structure_pair"), ["pair_id"], "loaded_at", ["source_content", "source_lang"]).where("source_lang = 'en' AND source_content IS NOT NULL")
    found = J.terms_in_text(docs, "source_content", rows, case_insensitive=True)
    return found.select("pair_id", F.explode("matched").alias("term")).select("pair_id", F.lower("term").alias("term"))


def glossary_top(spark: SparkSession, d: str) -> DataFrame:
    return glossary_match(spark, d).groupBy("term").agg(F.count_distinct("pair_id").alias("n_pages"))


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", F.explode(M.links(F.col("text"))).alias("link"))


def links_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Links that pages of the crawl have and no other page (set difference over all pages)."""
    x = link_extract(spark, d)
    return x.where("source = 'portal_crawl'").select("link").distinct().join(x.where("source != 'portal_crawl'").select("link"), "link", "left_anti")


def _run(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 10, "partial").when(F.col("event_type") == "view", "skipped").otherwise("success")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("path"), F.pmod("event_id", F.lit(7)).alias("ref"), status.alias("status"))


def run_report(spark: SparkSession, d: str) -> DataFrame:
    return R.status_summary(_run(spark, d))


def retry_pending(spark: SparkSession, d: str) -> DataFrame:
    x = _run(spark, d)
    old = x.where("event_id % 2 = 0 AND status IN ('failed', 'partial')").groupBy("path").agg(F.min("ref").alias("ref"))
    new = x.where("event_id % 2 = 1").groupBy("path").agg(F.max("ref").alias("ref"), F.max_by("status", "event_id").alias("status"))
    return R.pending_ledger(old, new, ["path"], "ref")


def keyword_delta(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts by initial letter, cheap against dear ones: which stand in one list only, and which differ in brand."""
    p = table(spark, d, "part").select(F.upper(F.substring("p_name", 1, 1)).alias("letter"), F.col("p_name").alias("word"), F.col("p_brand").alias("brand"), "p_size")
    base = p.where("p_size <= 30").groupBy("letter", "word").agg(F.min("brand").alias("brand"))
    head = p.where("p_size > 20").groupBy("letter", "word").agg(F.max("brand").alias("brand"))
    return R.keyed_changes(base, head, ["letter", "word"], "brand")


def redact(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events with what looks like a credential masked."""
    return table(spark, d, "events").select("event_id", M.redact(F.col("props")).alias("text"))


_D = """WITH df AS (SELECT * FROM diff_file QUALIFY row_number() OVER (PARTITION BY diff_id ORDER BY loaded_at DESC NULLS LAST, sync_id DESC NULLS LAST, side DESC NULLS LAST, filename DESC NULLS LAST,
  status DESC NULLS LAST, patch DESC NULLS LAST) = 1),
"""
_OPS = _D + r"""pl AS (SELECT diff_id, unnest(range(len(a)))::INT AS diff_index, unnest(a) AS raw FROM (
  SELECT diff_id, string_split(replace(replace(patch, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS a FROM df WHERE patch IS NOT NULL)),
hk AS (SELECT *, sum(h::INT) OVER (PARTITION BY diff_id ORDER BY diff_index) AS hunk FROM (SELECT *, regexp_matches(raw, '^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@') AS h FROM pl)),
hs AS (SELECT diff_id, hunk, regexp_extract(raw, '^@@ -(\d+)', 1)::INT AS o, regexp_extract(raw, '^@@ -\d+(?:,\d+)? \+(\d+)', 1)::INT AS n FROM hk WHERE h),
bd AS (SELECT hk.*, raw[1] AS sign, hs.o, hs.n FROM hk JOIN hs USING (diff_id, hunk) WHERE NOT h AND raw[1] IN ('+', '-', ' ')),
ops AS (SELECT diff_id, diff_index, hunk, CASE sign WHEN '+' THEN 'added' WHEN '-' THEN 'deleted' ELSE 'context' END AS op,
  CASE WHEN sign IN ('-', ' ') THEN (o + sum((sign IN ('-', ' '))::INT) OVER w - 1)::INT END AS old_line, CASE WHEN sign IN ('+', ' ') THEN (n + sum((sign IN ('+', ' '))::INT) OVER w - 1)::INT END AS new_line,
  (n + sum((sign IN ('+', ' '))::INT) OVER w - (sign IN ('+', ' '))::INT)::INT AS head_line, raw[2:] AS content, regexp_matches(raw[2:], '^#{1,10}\s+\S') AS is_header FROM bd WINDOW w AS (PARTITION BY diff_id, hunk ORDER BY diff_index))
"""
_SIDES = _OPS + r""", sides AS (SELECT diff_id, 'base' AS ref, old_line AS line_no, content AS text, op <> 'context' AS changed, length(regexp_extract(content, '^(#{1,10})\s+\S', 1)) AS level FROM ops WHERE op <> 'added'
  UNION ALL SELECT diff_id, 'head', new_line, content, op <> 'context', length(regexp_extract(content, '^(#{1,10})\s+\S', 1)) FROM ops WHERE op <> 'deleted')
"""


def _title(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '{M.TITLE_MARKS}', '', 'g'), '^\\s+|\\s+$', '', 'g')"


_RANGES = """, rg AS (SELECT diff_id, range_no, min(new_line) AS first_line, max(new_line) AS last_line, count(*) AS n FROM (
  SELECT *, sum(b) OVER (PARTITION BY diff_id ORDER BY new_line) AS range_no FROM (
    SELECT *, (coalesce(new_line - lag(new_line) OVER (PARTITION BY diff_id ORDER BY new_line), 3) > 2)::INT AS b FROM ops WHERE op = 'added')) GROUP BY diff_id, range_no)
"""
_A = """WITH ap AS (SELECT * FROM section_apply QUALIFY row_number() OVER (PARTITION BY apply_id ORDER BY loaded_at DESC NULLS LAST) = 1) """
_S = """WITH p AS (SELECT * FROM file_stats_primary QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY loaded_at DESC NULLS LAST, additions DESC NULLS LAST, deletions DESC NULLS LAST, status DESC NULLS LAST, is_md DESC NULLS LAST) = 1),
 r AS (SELECT * FROM file_stats_replica QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY loaded_at DESC NULLS LAST, additions DESC NULLS LAST, deletions DESC NULLS LAST, status DESC NULLS LAST, is_md DESC NULLS LAST) = 1)
"""
_LEVELS = _S + """, lv AS (SELECT r.run_id, r.path, r.is_md, p.path IS NOT NULL AS in_source,
  CASE WHEN r.is_md THEN abs(coalesce(r.additions, 0) - coalesce(p.additions, 0)) END AS add_diff, CASE WHEN r.is_md THEN abs(coalesce(r.deletions, 0) - coalesce(p.deletions, 0)) END AS del_diff
  FROM r LEFT JOIN p ON p.run_id = r.run_id AND p.path = r.path),
 lx AS (SELECT *, CASE WHEN NOT coalesce(is_md, false) THEN '' WHEN NOT in_source THEN 'target_only' WHEN add_diff = 0 AND del_diff = 0 THEN 'exact' WHEN add_diff > 5 OR del_diff > 5 THEN 'exceed' ELSE 'within' END AS level FROM lv) """
_LINKS = r"""WITH lk AS (SELECT DISTINCT doc_id, source, regexp_replace(unnest(regexp_extract_all(text, '\[[^\]\n]*\]\(([^)\s#]+\.md)(?:#[^)\s]*)?\)', 1)), '^(\.\.?/)*/*', '') AS link FROM documents WHERE text IS NOT NULL)
"""
_RUN = """WITH x AS (SELECT event_id, user_id AS path, event_id % 7 AS ref, CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 10 THEN 'partial' WHEN event_type = 'view' THEN 'skipped' ELSE 'success' END AS status FROM events) """
_GLOSS = """WITH t AS (SELECT DISTINCT lower(trim(en, ' ')) AS term FROM glossary WHERE en IS NOT NULL AND length(trim(en, ' ')) >= 2),
 dd AS (SELECT * FROM structure_pair QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC NULLS LAST, source_content DESC NULLS LAST) = 1),
 m AS (SELECT pair_id, term FROM dd JOIN t ON contains(lower(source_content), term) WHERE source_lang = 'en') """

QUERIES = {f.__name__: f for f in (
    diff_ops, diff_counts, noop_pairs, changed_ranges, insertion_groups, heading_prefixes, containing_section, restructured, heading_bags, reorder_lcs, level_only_changes, hunk_overlap, file_routing,
    missing_targets, report_levels, report_summary, changed_status, duplicate_sections, operation_counts, apply_order, section_chunks, mapping_problems, title_clean, anchor_slugs,
    heading_levels_set, step_match, zip_headings, nearest_line, parent_match, glossary_match, glossary_top, link_extract, links_in_scope, run_report, retry_pending, keyword_delta, redact)}
SQL = {
    "diff_ops": _OPS + "SELECT * FROM ops",
    "diff_counts": _OPS + "SELECT diff_id, count(*) FILTER (op = 'added') AS additions, count(*) FILTER (op = 'deleted') AS deletions, count(*) FILTER (op = 'context') AS context, count(*) FILTER (op <> 'context' AND is_header) AS header_changes, max(hunk)::BIGINT AS hunks FROM ops GROUP BY diff_id",
    "noop_pairs": _OPS + """, b AS (SELECT *, sum(g) OVER (PARTITION BY diff_id ORDER BY diff_index) AS block FROM (
      SELECT *, (coalesce(diff_index - lag(diff_index) OVER (PARTITION BY diff_id ORDER BY diff_index), 2) > 1)::INT AS g FROM ops WHERE op <> 'context'))
      SELECT diff_id, sum(n)::BIGINT AS noop_pairs FROM (SELECT diff_id, block, content, least(count(*) FILTER (op = 'added'), count(*) FILTER (op = 'deleted')) AS n FROM b GROUP BY ALL) GROUP BY diff_id""",
    "changed_ranges": _OPS + _RANGES + "SELECT diff_id, range_no::BIGINT AS range_no, first_line, last_line, n FROM rg",
    "insertion_groups": _OPS + """, h AS (SELECT *, max(CASE WHEN op = 'context' THEN new_line END) OVER (PARTITION BY diff_id ORDER BY new_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS al FROM ops WHERE is_header AND op <> 'deleted'),
      g AS (SELECT *, sum(b) OVER (PARTITION BY diff_id ORDER BY new_line) AS group_no FROM (SELECT *, (coalesce(new_line - lag(new_line) OVER (PARTITION BY diff_id ORDER BY new_line), 11) > 10)::INT AS b FROM h WHERE op = 'added')),
      q AS (SELECT diff_id, group_no::BIGINT AS group_no, count(*) AS n_headings, min(new_line) AS first_line, arg_min_null(al, new_line) AS anchor_line FROM g GROUP BY ALL)
      SELECT q.*, o.content AS anchor FROM q LEFT JOIN ops o ON o.diff_id = q.diff_id AND o.new_line = q.anchor_line""",
    "heading_prefixes": _OPS + r""", ad AS (SELECT diff_id, new_line, is_header, regexp_replace(content, '\s', '', 'g') = '' AS blank, regexp_matches(content, '^\s*(?:<CustomContent\b[^>]*>|`{3,})\s*$') AS wrap FROM ops WHERE op = 'added'),
      pa AS (SELECT h.diff_id, h.new_line AS heading_line, l.new_line, l.wrap FROM ad h JOIN ad l ON l.diff_id = h.diff_id AND h.is_header AND l.new_line < h.new_line
        WHERE (SELECT count(*) FROM ad x WHERE x.diff_id = h.diff_id AND x.new_line >= l.new_line AND x.new_line < h.new_line AND (x.blank OR x.wrap)) = h.new_line - l.new_line
          AND NOT EXISTS (SELECT 1 FROM ad x JOIN ad y ON y.diff_id = x.diff_id AND y.new_line = x.new_line + 1 WHERE x.diff_id = h.diff_id AND x.blank AND y.blank AND x.new_line >= l.new_line AND y.new_line < h.new_line))
      SELECT diff_id, heading_line, min(new_line) FILTER (wrap) AS first_line, heading_line - min(new_line) FILTER (wrap) AS n_lines, count(*) AS n_ignored FROM pa GROUP BY diff_id, heading_line HAVING bool_or(wrap)""",
    "containing_section": _SIDES + """SELECT diff_id, section_line, count(*) AS n_changed FROM (SELECT *, coalesce(max(CASE WHEN level > 0 THEN line_no END) OVER (PARTITION BY diff_id ORDER BY line_no), 0) AS section_line FROM sides WHERE ref = 'head') WHERE changed GROUP BY ALL""",
    "restructured": _SIDES + """, q AS (SELECT diff_id, count(*) FILTER (ref = 'head' AND level > 1) AS head_subs, count(*) FILTER (ref = 'base' AND level > 1) AS base_subs, count(*) FILTER (level > 1 AND NOT changed) AS kept,
      count(*) FILTER (ref = 'head' AND changed) AS c, count(*) FILTER (ref = 'head') AS n FROM sides GROUP BY diff_id)
      SELECT diff_id, head_subs, base_subs, kept, CASE WHEN n > 0 THEN c / n ELSE 0.0 END AS changed_share, greatest(head_subs, base_subs) >= 2 AND kept = 0 AND (CASE WHEN n > 0 THEN c / n ELSE 0.0 END) >= 0.5 AS restructured FROM q""",
    "heading_bags": _SIDES + f""", b AS (SELECT diff_id, {_title('text')} AS title, count(*) FILTER (ref = 'base') AS l, count(*) FILTER (ref = 'head') AS r FROM sides WHERE level > 0 GROUP BY ALL)
      SELECT diff_id, sum(l)::BIGINT AS left_size, sum(r)::BIGINT AS right_size, sum(least(l, r))::BIGINT AS common, sum(greatest(l - r, 0))::BIGINT AS left_only, sum(greatest(r - l, 0))::BIGINT AS right_only FROM b GROUP BY diff_id""",
    "level_only_changes": _A + r"SELECT apply_id, length(regexp_extract(source_new_content, '^(#{1,10})\s+\S', 1)) AS old_level, 2 AS new_level FROM ap WHERE regexp_matches(source_new_content, '^#{1,10}\s+\S') AND length(regexp_extract(source_new_content, '^(#{1,10})\s+\S', 1)) <> 2",
    "hunk_overlap": _OPS + _RANGES + """, hu AS (SELECT sync_id, hunk, min(new_line) AS first_line, max(new_line) AS last_line FROM ops JOIN df USING (diff_id) WHERE side = 'source' AND sync_id IS NOT NULL GROUP BY ALL)
      SELECT sync_id, hunk::BIGINT AS hunk, first_line, last_line FROM hu WHERE EXISTS (SELECT 1 FROM rg JOIN df USING (diff_id) WHERE df.side = 'target' AND df.sync_id = hu.sync_id AND hu.first_line <= rg.last_line AND hu.last_line >= rg.first_line)""",
    "file_routing": _D + r"""q AS (SELECT 1) SELECT diff_id, CASE WHEN starts_with(list_last(string_split(filename, '/')), 'TOC') THEN 'toc' WHEN regexp_matches(lower(filename), '\.(png|jpe?g|gif|svg|webp|bmp|ico)$') THEN 'image'
      WHEN ends_with(lower(filename), '.md') THEN 'markdown' ELSE 'other' END AS kind, replace(replace(replace(filename, '%', '%25'), '--', '%2D%2D'), '/', '--') AS path_key, coalesce(previous_filename, filename) AS old_name FROM df""",
    "missing_targets": _D + "q AS (SELECT 1) SELECT sync_id, diff_id, status FROM df WHERE side = 'source' AND NOT EXISTS (SELECT 1 FROM df t WHERE t.side = 'target' AND t.sync_id = df.sync_id)",
    "report_levels": _LEVELS + "SELECT run_id, path, is_md, in_source, add_diff, del_diff, level FROM lx",
    "report_summary": _LEVELS + "SELECT run_id, level, count(*) AS n FROM lx GROUP BY ALL",
    "changed_status": _S + """, k AS (SELECT coalesce(p.run_id, r.run_id) AS run_id, coalesce(p.path, r.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN r.path IS NULL THEN 'deleted'
      WHEN trim(p.status, ' ') IS DISTINCT FROM trim(r.status, ' ') THEN 'modified' END AS change FROM p FULL JOIN r ON p.run_id = r.run_id AND p.path = r.path) SELECT * FROM k WHERE change IS NOT NULL""",
    "duplicate_sections": _A + "SELECT repo, section_key, count(*) AS n, min(apply_id) AS first_id FROM ap GROUP BY ALL HAVING count(*) > 1",
    "operation_counts": _A + "SELECT source_operation, count(*) AS n, count(DISTINCT path) AS n_paths, sum(length(source_new_content))::BIGINT AS chars FROM ap GROUP BY source_operation",
    "apply_order": _A + "SELECT repo, path, apply_id, target_line, row_number() OVER (PARTITION BY repo, path ORDER BY CASE WHEN target_line = -1 THEN 2 ELSE 1 END NULLS FIRST, CASE WHEN target_line <> -1 THEN -target_line END NULLS FIRST, apply_id) AS rank FROM ap",
    "section_chunks": _A + """, v AS (SELECT repo, path, list({'p': apply_id, 's': (coalesce(length(source_new_content), 0) + coalesce(length(source_old_content), 0))::BIGINT} ORDER BY apply_id) AS v FROM ap GROUP BY repo, path),
      f AS (SELECT repo, path, list_reduce(list_transform(v, lambda x: {'no': 0::BIGINT, 'n': 0::BIGINT, 's': x.s, 'p': x.p, 'o': []::STRUCT(p BIGINT, s BIGINT, c BIGINT)[]}), lambda a, x: CASE
        WHEN a.n = 0 OR a.n >= 8 OR a.s + x.s > 4000 THEN {'no': a.no + 1, 'n': 1::BIGINT, 's': x.s, 'p': x.p, 'o': list_append(a.o, {'p': x.p, 's': x.s, 'c': a.no + 1})}
        ELSE {'no': a.no, 'n': a.n + 1, 's': a.s + x.s, 'p': x.p, 'o': list_append(a.o, {'p': x.p, 's': x.s, 'c': a.no})} END,
        {'no': 0::BIGINT, 'n': 0::BIGINT, 's': 0::BIGINT, 'p': 0::BIGINT, 'o': []::STRUCT(p BIGINT, s BIGINT, c BIGINT)[]}) AS r FROM v)
      SELECT repo, path, o.p AS apply_id, o.s AS chars, o.c::INT AS chunk_no FROM (SELECT repo, path, unnest(r.o) AS o FROM f)""",
    "mapping_problems": _A + r""", q AS (SELECT repo, path, apply_id, nullif(target_line, -1) AS target_line, length(regexp_extract(list_last(string_split(source_original_hierarchy, ' > ')), '^(#+)', 1)) AS sl,
      length(regexp_extract(list_last(string_split(target_hierarchy, ' > ')), '^(#+)', 1)) AS tl FROM ap WHERE source_operation <> 'added'),
      w AS (SELECT *, count(*) OVER (PARTITION BY repo, path, target_line) AS n FROM q)
      SELECT repo, path, apply_id, target_line, 'missing_target' AS problem FROM w WHERE target_line IS NULL UNION ALL SELECT repo, path, apply_id, target_line, 'duplicate_target' FROM w WHERE target_line IS NOT NULL AND n > 1
      UNION ALL SELECT repo, path, apply_id, target_line, 'level_mismatch' FROM w WHERE target_line IS NOT NULL AND sl <> tl""",
    "title_clean": _A + f"SELECT apply_id, {_title('leaf')} AS title, regexp_matches(leaf, '[一-鿿]') AS cjk FROM (SELECT apply_id, list_last(string_split(source_original_hierarchy, ' > ')) AS leaf FROM ap)",
    "heading_levels_set": _A + r"SELECT apply_id, sha256(CASE WHEN regexp_matches(source_new_content, '^#{1,10}\s+\S') THEN '#### ' || regexp_replace(source_new_content, '^#{1,10}\s+', '') ELSE source_new_content END) AS text_hash FROM ap WHERE source_new_content IS NOT NULL",
    "step_match": pages.BASE + """, s AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, level ORDER BY line_no) AS step FROM heads)
      SELECT a.pair_id, a.level, a.step, a.line_no AS left_pos, b.line_no AS right_pos FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.level = b.level AND a.step = b.step AND a.side = 'source' AND b.side = 'target'""",
    "zip_headings": pages.BASE + "SELECT a.pair_id, a.line_no AS left_line_no, a.level AS left_level, b.line_no AS right_line_no, b.level AS right_level FROM heads a JOIN heads b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 'source' AND b.side = 'target'",
    "nearest_line": pages.BASE + """, c AS (SELECT pair_id, side, line_no, regexp_extract(text, '`([^`]+)`', 1) AS name FROM lines WHERE NOT in_fence AND regexp_extract(text, '`([^`]+)`', 1) <> '')
      SELECT t.pair_id, t.name, t.line_no AS target_line, s.line_no AS source_line FROM c t JOIN c s ON s.pair_id = t.pair_id AND s.name = t.name AND s.side = 'source' WHERE t.side = 'target'
      QUALIFY row_number() OVER (PARTITION BY t.pair_id, t.name, t.line_no ORDER BY abs(s.line_no - t.line_no), s.line_no) = 1""",
    "glossary_match": _GLOSS + "SELECT pair_id, term FROM m",
    "glossary_top": _GLOSS + "SELECT term, count(DISTINCT pair_id) AS n_pages FROM m GROUP BY term",
    "link_extract": _LINKS + "SELECT doc_id, source, link FROM lk",
    "links_in_scope": _LINKS + "SELECT DISTINCT link FROM lk WHERE source = 'portal_crawl' AND link NOT IN (SELECT link FROM lk WHERE source <> 'portal_crawl')",
    "run_report": _RUN + "SELECT count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status <> 'skipped') AS n_total, bool_and(status IN ('success', 'skipped')) AS all_done FROM x",
    "retry_pending": _RUN + """, o AS (SELECT path, min(ref) AS ref FROM x WHERE event_id % 2 = 0 AND status IN ('failed', 'partial') GROUP BY path), n AS (SELECT path, max(ref) AS ref, arg_max(status, event_id) AS status FROM x WHERE event_id % 2 = 1 GROUP BY path)
      SELECT coalesce(o.path, n.path) AS path, coalesce(o.ref, n.ref) AS ref FROM o FULL JOIN n ON o.path = n.path WHERE coalesce(n.status, 'failed') NOT IN ('success', 'skipped')""",
    "keyword_delta": """WITH p AS (SELECT upper(p_name[1]) AS letter, p_name AS word, p_brand AS brand, p_size FROM part), b AS (SELECT letter, word, min(brand) AS brand FROM p WHERE p_size <= 30 GROUP BY ALL),
      h AS (SELECT letter, word, max(brand) AS brand FROM p WHERE p_size > 20 GROUP BY ALL), q AS (SELECT coalesce(b.letter, h.letter) AS letter, coalesce(b.word, h.word) AS word,
      CASE WHEN b.word IS NULL THEN 'added' WHEN h.word IS NULL THEN 'deleted' WHEN trim(b.brand, ' ') IS DISTINCT FROM trim(h.brand, ' ') THEN 'modified' END AS change FROM b FULL JOIN h ON b.letter = h.letter AND b.word = h.word)
      SELECT * FROM q WHERE change IS NOT NULL""",
    "redact": "SELECT event_id, regexp_replace(regexp_replace(props, '" + M.SECRET_USER + r"', '\1[REDACTED]@', 'g'), '" + M.SECRET_AFTER.replace("'", "''") + r"', '\1[REDACTED]', 'g') AS text FROM events",
    "anchor_slugs": pages.BASE + r"""SELECT pair_id, line_no, array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\s*\{#[^}]+\}\s*$|\]\([^)]+\)|`', '', 'g'), '</?[^>]+>', ' ', 'g'),
      '(\d)\.(\d)', '\1\2', 'g'), '(\d)\.(\d)', '\1\2', 'g')), '[a-z0-9]+'), '-') AS slug FROM heads WHERE side = 'source'""",
}
