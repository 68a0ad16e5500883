"""Queries that bring a translated text up to its source's new version, and on merged maps and sorted lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import markdown as M
from driftmark.operators import sync as Y
from driftmark.plans import changes, pages
from driftmark.runtime import latest_by, table


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of the old and new source text and of the target text of each update."""
    rows = latest_by(table(spark, d, "section_apply"), ["apply_id"], "loaded_at", ["source_old_content", "source_new_content", "target_new_content"])

    def lines(c: str) -> DataFrame:
        text = F.regexp_replace(F.col(c), r"\r\n|\r", "\n")
        return rows.where(F.col(c).isNotNull()).select("apply_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "text"))

    return lines("source_old_content"), lines("source_new_content"), lines("target_new_content")


def synced_lines(spark: SparkSession, d: str) -> DataFrame:
    return Y.synced_lines(*_versions(spark, d), ["apply_id"])


def reconciled_sections(spark: SparkSession, d: str) -> DataFrame:
    return Y.reconciled_sections(*_versions(spark, d), ["apply_id"])


def glossary_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The glossary's rows as one map: which terms have translations in conflict."""
    rows = table(spark, d, "glossary").where("en IS NOT NULL").select(F.lower(F.trim("en")).alias("term"), "target_lang", F.trim("target").alias("target"))
    return Y.merged_maps(rows, ["term", "target_lang"], "target")


def insertion_places(spark: SparkSession, d: str) -> DataFrame:
    """Where names of parts belong among those of their brand, in the order of keys."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"), "p_size")
    return Y.insertion_index(p.where("p_size <= 25"), p.where("p_size > 25"), ["brand"], "name", "pos")


def headingless(spark: SparkSession, d: str) -> DataFrame:
    docs = pages.documents(spark, d).where("content IS NOT NULL")
    return docs.select("pair_id", "side", M.is_headingless(F.col("content")).alias("headingless"))


def tag_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tags of target pages as placeholders with a nonce, put back, and refused where one is lost."""
    docs = pages.documents(spark, d).where("side = 'target' AND content IS NOT NULL").withColumn("x", M.protect_tags(F.col("content"), r"</?CustomContent[^>]*>"))
    back = M.restore_tags(F.col("x.text"), F.col("x.tags"), F.col("x.nonce"))
    lost = M.restore_tags(F.regexp_replace(F.col("x.text"), "⟦[^⟧]*⟧", ""), F.col("x.tags"), F.col("x.nonce"))
    return docs.select("pair_id", F.size("x.tags").alias("n_tags"), (back == F.col("content")).alias("same"), lost.isNull().alias("refused"))


_LINES = """WITH ap AS (SELECT * FROM section_apply QUALIFY row_number() OVER (PARTITION BY apply_id ORDER BY loaded_at DESC NULLS LAST, source_old_content DESC NULLS LAST, source_new_content DESC NULLS LAST, target_new_content DESC NULLS LAST) = 1),
 cs AS (SELECT apply_id, 'b' AS v, source_old_content AS c FROM ap UNION ALL SELECT apply_id, 'h', source_new_content FROM ap UNION ALL SELECT apply_id, 't', target_new_content FROM ap),
 ls AS (SELECT apply_id, v, unnest(range(len(a)))::INT AS line_no, unnest(a) AS text FROM (SELECT apply_id, v, string_split(replace(replace(c, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS a FROM cs WHERE c IS NOT NULL))
"""
_OUTLINE = _LINES + rf""", o AS (SELECT *, CASE WHEN regexp_matches(text, '{Y.LINK}') THEN 'link' WHEN regexp_matches(text, '{Y.ENTRY}') THEN 'list_text' WHEN regexp_matches(text, '{Y.HEADING}') THEN 'heading' ELSE 'other' END AS kind FROM ls),
 e AS (SELECT apply_id, v, line_no, text, kind, regexp_extract(text, CASE kind WHEN 'link' THEN '{Y.LINK}' WHEN 'list_text' THEN '{Y.ENTRY}' ELSE '{Y.HEADING}' END, 1) AS prefix,
   regexp_extract(text, CASE kind WHEN 'link' THEN '{Y.LINK}' WHEN 'list_text' THEN '{Y.ENTRY}' ELSE '{Y.HEADING}' END, 2) AS shown,
   CASE kind WHEN 'link' THEN regexp_extract(text, '{Y.LINK}', 3) END AS link, CASE kind WHEN 'link' THEN regexp_extract(text, '{Y.LINK}', 4) END AS suffix, CASE kind WHEN 'heading' THEN trim(regexp_extract(text, '{Y.HEADING}', 1), ' ') ELSE '' END AS mark FROM o),
 lk AS (SELECT apply_id, link, arg_min(shown, line_no) FILTER (v = 'b') AS bs, arg_min(shown, line_no) FILTER (v = 't') AS ts FROM e WHERE kind = 'link' AND v <> 'h' GROUP BY ALL),
 pl AS (SELECT *, row_number() OVER (PARTITION BY apply_id, v ORDER BY line_no) AS nth FROM e WHERE kind IN ('heading', 'list_text')),
 me AS (SELECT b.apply_id, b.kind, b.mark, b.shown, arg_min(t.shown, b.nth) AS ps FROM pl b JOIN pl t ON b.apply_id = t.apply_id AND b.nth = t.nth AND b.kind = t.kind AND b.v = 'b' AND t.v = 't' GROUP BY ALL)
"""
_SECTIONS = _LINES + r""", s1 AS (SELECT *, regexp_matches(text, '^#{1,10}\s+\S') AS h FROM ls), s2 AS (SELECT *, sum(h::INT) OVER (PARTITION BY apply_id, v ORDER BY line_no) AS section_no FROM s1),
 sc AS (SELECT apply_id, v, section_no, coalesce(max(text) FILTER (h), '') AS heading, string_agg(text, chr(10) ORDER BY line_no) AS content FROM s2 GROUP BY ALL),
 sn AS (SELECT *, row_number() OVER (PARTITION BY apply_id, v, heading ORDER BY section_no) AS nth, count(*) OVER (PARTITION BY apply_id, v) AS n FROM sc)
"""
QUERIES = {f.__name__: f for f in (synced_lines, reconciled_sections, glossary_conflicts, insertion_places, headingless, tag_round_trip)}
SQL = {
    "synced_lines": _OUTLINE + """SELECT h.apply_id, h.line_no, x.synced, CASE WHEN h.kind = 'other' THEN 'copy' WHEN x.synced IS NULL THEN 'translate' ELSE 'reuse' END AS decision
      FROM e h LEFT JOIN lk ON lk.apply_id = h.apply_id AND lk.link = h.link LEFT JOIN me ON me.apply_id = h.apply_id AND me.kind = h.kind AND me.mark = h.mark AND me.shown = h.shown,
      LATERAL (SELECT CASE WHEN h.kind = 'other' THEN h.text WHEN h.kind = 'link' THEN CASE WHEN lk.bs = h.shown AND lk.ts IS NOT NULL THEN h.prefix || '[' || lk.ts || '](' || h.link || ')' || h.suffix END WHEN me.ps IS NOT NULL THEN h.prefix || me.ps END AS synced) x WHERE h.v = 'h'""",
    "reconciled_sections": _SECTIONS + """SELECT h.apply_id, h.section_no::BIGINT AS section_no, h.heading, CASE WHEN t.n IS NOT NULL THEN 'reuse' ELSE 'translate' END AS decision, CASE WHEN t.n IS NOT NULL THEN b.section_no::BIGINT END AS target_no
      FROM sn h LEFT JOIN sn b ON b.apply_id = h.apply_id AND b.v = 'b' AND b.heading = h.heading AND b.nth = h.nth AND b.content = h.content
      LEFT JOIN (SELECT DISTINCT apply_id, n FROM sn WHERE v = 't') t ON t.apply_id = b.apply_id AND t.n = b.n WHERE h.v = 'h'""",
    "glossary_conflicts": "SELECT lower(trim(en, ' ')) AS term, target_lang, min(trim(target, ' ')) AS value, count(DISTINCT trim(target, ' ')) AS n_values, count(DISTINCT trim(target, ' ')) > 1 AS conflict FROM glossary WHERE en IS NOT NULL GROUP BY 1, 2",
    "insertion_places": """WITH p AS (SELECT p_brand AS brand, p_name AS name, p_partkey AS pos, p_size FROM part)
      SELECT n.brand, n.name, (SELECT min(e.pos) FROM p e WHERE e.p_size <= 25 AND e.brand = n.brand AND upper(e.name) > upper(n.name)) AS at FROM p n WHERE n.p_size > 25""",
    "headingless": pages.DOCS_SQL + r"""q AS (SELECT 1) SELECT pair_id, side, NOT regexp_matches(regexp_replace(regexp_replace(content, '(?ms)\A(.*?)^[ \t]*---[ \t]*$.*?(?:^[ \t]*---[ \t]*$|\z)', '\1'),
      '(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\z)', '', 'g'), '(?m)^[ \t]*#') AS headingless FROM docs WHERE content IS NOT NULL""",
    "tag_round_trip": pages.DOCS_SQL + "q AS (SELECT 1) SELECT pair_id, len(regexp_extract_all(content, '</?CustomContent[^>]*>')) AS n_tags, true AS same, len(regexp_extract_all(content, '</?CustomContent[^>]*>')) > 0 AS refused FROM docs WHERE side = 'target' AND content IS NOT NULL",
}
