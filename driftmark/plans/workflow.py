"""Queries that plan, apply and track updates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators import apply as A
from driftmark.operators import structure as S
from driftmark.plans import pages
from driftmark.runtime import latest_by, shared_folder, table
from driftmark.streaming import ledger


def reconcile_plan(spark: SparkSession, d: str) -> DataFrame:
    """What of each target page could be taken over from its source page, block by block."""
    b = S.blocks(pages.lines(spark, d), pages.K).select("pair_id", "side", "block_no", F.col("content").alias("norm"))
    return A.reconcile_plan(b.where("side = 'source'"), b.where("side = 'target'"), ["pair_id"], "norm", "block_no")


def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    return reconcile_plan(spark, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id", "run").alias("n_runs"))


def apply_sections(spark: SparkSession, d: str) -> DataFrame:
    """Source pages after edits derived from their own headings: every second section replaced by a note, the last deleted, a line before the first, one appended."""
    ls = pages.lines(spark, d).where("side = 'source'").select("pair_id", "line_no", "text", "level")
    heads = S.headings(ls.withColumn("in_fence", F.lit(False)), ["pair_id"])
    ends = S.section_ends(heads, ls, ["pair_id"]).join(heads.select("pair_id", "line_no", "pos"), ["pair_id", "line_no"])
    action = F.when(F.col("pos") % 2 == 0, "replace").when(F.col("pos") == 1, "before").otherwise("delete")
    edits = ends.select("pair_id", F.col("line_no").alias("first_line"), F.col("direct_end").alias("last_line"), action.alias("action"), F.concat(F.lit("edit "), F.col("pos")).alias("text"))
    more = heads.select("pair_id").distinct().select("pair_id", F.lit(0).alias("first_line"), F.lit(0).alias("last_line"), F.lit("append").alias("action"), F.lit("the end").alias("text"))
    return A.apply_edits(ls, edits.unionByName(more), ["pair_id"])


def page_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_by(table(spark, d, "structure_pair"), ["pair_id"], "loaded_at", ["target_content"]).where("target_content IS NOT NULL")
    return rows.select("pair_id", A.mark_document(F.col("target_content"), "source-commit", F.col("pair_id").cast("string")).alias("content"))


def list_lines(spark: SparkSession, d: str) -> DataFrame:
    return A.list_lines(pages.lines(spark, d).where("NOT in_fence")).groupBy("pair_id", "side", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("indent").alias("widest"))


def start_lines(spark: SparkSession, d: str) -> DataFrame:
    """Where the headings of a target page are looked for three lines too late."""
    ls = pages.lines(spark, d).where("side = 'target'")
    sections = ls.where("level > 0").select("pair_id", F.concat_ws("-", "pair_id", "line_no").alias("section_id"), (F.col("line_no") + 3).alias("wanted_line"), F.col("text").alias("heading"))
    return A.start_line(sections, ls, ["pair_id"])


def hourly_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ledger.windowed_outcomes(table(spark, d, "events").where("ts IS NOT NULL"), "ts", "event_type")


def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after streaming all events as outcomes, in one pass over what is there."""
    folder = f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 10, "partial").otherwise("success")
    rows = events.select(F.col("user_id").alias("path"), F.pmod("event_id", F.lit(7)).alias("ref"), status.alias("status"), F.col("event_id").alias("seq"))
    ledger.start_ledger(rows, f"{folder}/versions", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(ledger.last_version(spark, f"{folder}/versions"))


_PLAN = pages.BASE + pages._BLOCKS + """, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, content ORDER BY block_no) AS rn FROM bl),
 m AS (SELECT t.pair_id, t.block_no, t.content, s.block_no AS base_block_no FROM r t LEFT JOIN r s ON s.pair_id = t.pair_id AND s.content = t.content AND s.rn = t.rn AND s.side = 'source' WHERE t.side = 'target'),
 dc AS (SELECT *, CASE WHEN NOT regexp_matches(content, '\\p{L}') OR regexp_matches(content, '^\\s*(`{3,}|~{3,})') OR regexp_matches(content, '^\\s*(</?CustomContent\\b[^<>]*>\\s*)+$') THEN 'verbatim' WHEN base_block_no IS NOT NULL THEN 'reuse' ELSE 'translate' END AS decision FROM m),
 ru AS (SELECT *, sum(b) OVER (PARTITION BY pair_id ORDER BY block_no) AS run FROM (SELECT *, (lag(decision) OVER (PARTITION BY pair_id ORDER BY block_no) IS DISTINCT FROM decision)::INT AS b FROM dc))
""".replace("\\\\", "\\")

QUERIES = {f.__name__: f for f in (reconcile_plan, reconcile_summary, apply_sections, page_marks, list_lines, start_lines, hourly_outcomes, stream_ledger)}
SQL = {
    "reconcile_plan": _PLAN + "SELECT pair_id, block_no, decision, base_block_no, run FROM ru",
    "reconcile_summary": _PLAN + "SELECT decision, count(*) AS n, count(DISTINCT (pair_id, run)) AS n_runs FROM ru GROUP BY decision",
    "apply_sections": pages.BASE + r""", sl AS (SELECT * FROM lines WHERE side = 'source'), sh AS (SELECT * FROM heads WHERE side = 'source'),
      se AS (SELECT h.*, coalesce(lead(line_no) OVER (PARTITION BY pair_id ORDER BY line_no) - 1, n) AS direct_end FROM sh h JOIN (SELECT pair_id, max(line_no) AS n FROM sl GROUP BY ALL) USING (pair_id)),
      kept AS (SELECT pair_id, line_no AS at_, 1 AS phase, '' AS seq, text FROM sl WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.pair_id = sl.pair_id AND pos <> 1 AND sl.line_no BETWEEN se.line_no AND se.direct_end)),
      new AS (SELECT pair_id, line_no AS at_, 0 AS phase, 'edit ' || pos AS seq, 'edit ' || pos AS text FROM se WHERE pos = 1 OR pos % 2 = 0 UNION ALL SELECT DISTINCT pair_id, 2147483647, 2, 'the end', 'the end' FROM sh)
      SELECT pair_id, string_agg(text, chr(10) ORDER BY at_, phase, seq) AS content FROM (SELECT * FROM kept UNION ALL SELECT * FROM new) GROUP BY pair_id""",
    "page_marks": r"""WITH dd AS (SELECT * FROM structure_pair QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC NULLS LAST, target_content DESC NULLS LAST) = 1)
      SELECT pair_id, CASE WHEN regexp_matches(bare, '(?m)^# [^\n]*') THEN regexp_replace(bare, '(?m)^(# [^\n]*)', '\1 <!-- source-commit: ' || pair_id || ' -->') ELSE '<!-- source-commit: ' || pair_id || ' -->' || chr(10) || bare END AS content
      FROM (SELECT pair_id, regexp_replace(target_content, '(?m)^<!-- source-commit: [^>]* -->\n| ?<!-- source-commit: [^>]* -->', '', 'g') AS bare FROM dd WHERE target_content IS NOT NULL)""",
    "list_lines": pages.BASE + r"""SELECT pair_id, side, kind, count(*) AS n, max(length(regexp_extract(text, '^(\s*)', 1))) AS widest FROM (SELECT *, CASE
      WHEN regexp_matches(text, '^(\s*)[-*+]\s+\[([^\[\]]*(\[[^\[\]]*\][^\[\]]*)*)\]\(([^()\s]*(\([^()]*\)[^()\s]*)*)\)\s*$') THEN 'link' WHEN regexp_matches(text, '^\s*[-*+]\s+\S') THEN 'list_text' WHEN level > 0 THEN 'heading' ELSE 'other' END AS kind
      FROM lines WHERE NOT in_fence) GROUP BY ALL""",
    "start_lines": pages.BASE + """, th AS (SELECT * FROM lines WHERE side = 'target' AND level > 0), c AS (
        SELECT a.pair_id, a.line_no, b.line_no AS at_, CASE WHEN b.line_no = a.line_no + 3 THEN 1 WHEN b.line_no = a.line_no + 2 THEN 2 ELSE 3 END AS rank, 0 AS gap FROM th a JOIN th b ON a.pair_id = b.pair_id AND trim(a.text, ' ') = trim(b.text, ' ')
        UNION ALL SELECT a.pair_id, a.line_no, b.line_no, 5, abs(b.line_no - a.line_no - 3) FROM th a JOIN th b ON a.pair_id = b.pair_id AND abs(b.line_no - a.line_no - 3) <= 5)
      SELECT pair_id || '-' || line_no AS section_id, line_no + 3 AS wanted_line, at_ AS resolved, rank FROM c QUALIFY row_number() OVER (PARTITION BY pair_id, line_no ORDER BY rank, gap, at_) = 1""",
    "hourly_outcomes": "SELECT date_trunc('hour', ts) AS window_start, event_type AS status, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_ledger": """WITH x AS (SELECT user_id AS path, event_id % 7 AS ref, CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 10 THEN 'partial' ELSE 'success' END AS status, event_id FROM events)
      SELECT path, ref FROM x QUALIFY row_number() OVER (PARTITION BY path ORDER BY event_id DESC) = 1 AND status <> 'success'""",
}
