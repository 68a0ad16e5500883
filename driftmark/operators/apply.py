"""Applying updates to documents as set operations on their lines.

IDs: SEQ1 SEQ3 SEQ4 SEQ7 SNK7 STR12 STR13 JOIN19. No edit moves another: every line has the order key (line, phase,
sequence), removed ranges leave by an anti-join, new lines enter by union, and one aggregate puts the text together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.functions.markdown import is_verbatim

BEFORE, OWN, AFTER = 0, 1, 2


def apply_edits(lines: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """``content`` per document after all ``edits`` (first_line, last_line, action, text) to ``lines`` (line_no, text).

    action: ``replace`` and ``delete`` take the lines first_line to last_line; ``before`` inserts above first_line,
    ``append`` at the end. A null text inserts nothing. Edits of one place apply in the order of their text; ranges may
    overlap, a line that any of them takes is gone. Documents without edits come out as they are; without lines, none.
    """
    cut = edits.where("action IN ('replace', 'delete')").select(*keys, "first_line", "last_line")
    cond = [lines[k] == cut[k] for k in keys] + [lines["line_no"] >= cut["first_line"], lines["line_no"] <= cut["last_line"]]
    kept = lines.join(cut, cond, "left_anti").select(*keys, F.col("line_no").alias("at"), F.lit(OWN).alias("phase"), F.lit("").alias("seq"), "text")
    new = edits.where("action != 'delete' AND text IS NOT NULL").select(
        *keys, F.when(F.col("action") == "append", F.lit(2147483647)).otherwise(F.col("first_line")).alias("at"),
        F.when(F.col("action") == "append", AFTER).otherwise(BEFORE).alias("phase"), F.col("text").alias("seq"), "text")
    new = new.join(lines.select(*keys).distinct(), keys, "left_semi")
    return kept.unionByName(new).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "phase", "seq", "text"))).alias("r")).select(
        *keys, F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("content"))


def reconcile_plan(base: DataFrame, head: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """A ``decision`` per head block: ``reuse`` the translation of the base block of equal text, keep ``verbatim`` what has nothing to translate, or ``translate``; ``run`` numbers stretches of equal decisions."""
    from driftmark.operators.matching import multiset_positions

    m = multiset_positions(head, base, keys, value, pos)
    m = m.withColumn("decision", F.when(is_verbatim(F.col(value)), "verbatim").when(F.col("right_pos").isNotNull(), "reuse").otherwise("translate"))
    w = W.partitionBy(*keys).orderBy("left_pos")
    m = m.withColumn("begins", (~F.lag("decision").over(w).eqNullSafe(F.col("decision"))).cast("int"))
    return m.select(*keys, F.col("left_pos").alias("block_no"), "decision", F.col("right_pos").alias("base_block_no"), F.sum("begins").over(w).alias("run"))


def list_lines(lines: DataFrame) -> DataFrame:
    """Lines with their kind: ``link`` (indent, text, target), ``list_text``, ``heading`` or ``other``."""
    link = r"^(\s*)[-*+]\s+\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]\(([^()\s]*(?:\([^()]*\)[^()\s]*)*)\)\s*$"
    kind = F.when(F.col("text").rlike(link), "link").when(F.col("text").rlike(r"^\s*[-*+]\s+\S"), "list_text").when(F.col("level") > 0, "heading").otherwise("other")
    return lines.withColumn("kind", kind).withColumn("indent", F.length(F.regexp_extract("text", r"^(\s*)", 1))).withColumn(
        "target", F.when(F.col("kind") == "link", F.regexp_extract("text", link, 3)))


def mark_document(content: F.Column, name: str, value: F.Column) -> F.Column:
    """The text with a comment ``name: value`` at its first level-1 heading, replacing one that is there; else as the first line."""
    note = F.concat(F.lit(f"<!-- {name}: "), value, F.lit(" -->"))
    bare = F.regexp_replace(content, rf"(?m)^<!-- {name}: [^>]* -->\n| ?<!-- {name}: [^>]* -->", "")
    first = F.regexp_instr(bare, F.lit(r"(?m)^# [^\n]*"))
    head = F.regexp_extract(bare, r"(?m)^(# [^\n]*)", 1)
    with_head = F.concat(F.substring(bare, F.lit(1), first - 1), head, F.lit(" "), note, F.substring(bare, first + F.length(head), F.length(bare)))
    return F.when(first > 0, with_head).otherwise(F.concat(note, F.lit("\n"), bare))


def start_line(sections: DataFrame, lines: DataFrame, keys: list[str], reach: int = 5) -> DataFrame:
    """``resolved`` line of each section (section_id, wanted_line, heading): the wanted line if it is that heading, else the one before, else the first such heading, else the nearest heading within ``reach``, else the wanted line.

    Joined by key and heading text, and by key and line, so no pair of all sections and lines arises.
    """
    heads = lines.where("level > 0").select(*keys, F.col("line_no").alias("at"), F.trim("text").alias("h"))
    same = sections.join(heads, (([sections[k] == heads[k] for k in keys])) + [F.trim(sections["heading"]) == heads["h"]]).select(
        sections["section_id"], "at", F.when(F.col("at") == F.col("wanted_line"), 1).when(F.col("at") == F.col("wanted_line") - 1, 2).otherwise(3).alias("rank"), F.lit(0).alias("gap"))
    near = sections.select("section_id", *keys, "wanted_line", F.explode(F.sequence(F.col("wanted_line") - reach, F.col("wanted_line") + reach)).alias("at"))
    near = near.join(heads.select(*keys, "at"), [*keys, "at"]).select("section_id", "at", F.lit(5).alias("rank"), F.abs(F.col("at") - F.col("wanted_line")).alias("gap"))
    best = same.unionByName(near).groupBy("section_id").agg(F.min(F.struct("rank", "gap", "at")).alias("b"))
    return sections.join(best, "section_id", "left").select("section_id", "wanted_line", F.coalesce("b.at", "wanted_line").alias("resolved"), F.coalesce("b.rank", F.lit(6)).alias("rank"))
