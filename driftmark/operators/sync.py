"""A translated file brought up to its source's new version: what of it can stay, line by line or section by section.

IDs: SEQ2 SEQ4 SEQ5 SC19 SET5 SRT7. Everything is joins on keys and windows within a file; nothing is looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A list entry that is a link: prefix, text, target, rest.
LINK = r"^(\s*[-*+]\s+)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^)]*)\)(.*)$"
#: Other list entries and headings: prefix, text.
ENTRY = r"^(\s*[-*+]\s+)(\S.*)$"
HEADING = r"^(#{1,6}\s+)(\S.*)$"


def outline(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines with ``kind`` (link, list_text, heading, other), ``prefix``, ``shown``, ``link`` and ``suffix``."""
    t = F.col(text)
    kind = F.when(t.rlike(LINK), "link").when(t.rlike(ENTRY), "list_text").when(t.rlike(HEADING), "heading").otherwise("other")

    def part(link: int | None, plain: int | None) -> Column:
        out = F.when(F.col("kind") == "link", F.regexp_extract(t, LINK, link)) if link else F.when(F.lit(False), F.lit(""))
        if plain:
            out = out.when(F.col("kind") == "list_text", F.regexp_extract(t, ENTRY, plain)).when(F.col("kind") == "heading", F.regexp_extract(t, HEADING, plain))
        return out

    return lines.withColumn("kind", kind).withColumns({"prefix": part(1, 1), "shown": part(2, 2), "link": part(3, None), "suffix": part(4, None)})


def synced_lines(base: DataFrame, head: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of ``head`` (keys, line_no, text) with ``synced``, what stands in the new target, and ``decision``.

    A link whose text is that of the first such link of ``base`` takes the text of the first target link of its address; a
    heading or list entry takes that of the target line at the place, among headings and entries, of the first equal one of the base,
    if that is of its kind. Both keep the head's prefix, address and rest: ``reuse``. Other links, headings and entries are to
    ``translate`` (null), all other lines ``copy``. Null keys match nothing. Empty sides give only lines to translate or copy.
    """
    b, h, t = (outline(x.select(*keys, "line_no", "text")) for x in (base, head, target))
    first = lambda x, name: x.where("kind = 'link'").groupBy(*keys, "link").agg(F.min_by("shown", "line_no").alias(name))
    links = first(b, "base_shown").join(first(t, "target_shown"), [*keys, "link"])
    w = W.partitionBy(*keys).orderBy("line_no")
    plain = lambda x: x.where("kind IN ('heading', 'list_text')").withColumn("__nth", F.row_number().over(w))
    # Entries are equal by text, headings by level and text.
    same = F.when(F.col("kind") == "heading", F.trim("prefix")).otherwise("")
    memory = plain(b).withColumn("__mark", same).join(plain(t).select(*keys, "__nth", F.col("kind").alias("__k"), F.col("shown").alias("__s")), [*keys, "__nth"]).where("kind = __k")
    memory = memory.groupBy(*keys, "kind", "__mark", "shown").agg(F.min_by("__s", "__nth").alias("plain_shown"))
    rows = h.withColumn("__mark", same).join(links, [*keys, "link"], "left").join(memory, [*keys, "kind", "__mark", "shown"], "left")
    linked = (F.col("kind") == "link") & (F.col("base_shown") == F.col("shown")) & F.col("target_shown").isNotNull()
    text = (F.when(linked, F.concat("prefix", F.lit("["), "target_shown", F.lit("]("), "link", F.lit(")"), "suffix"))
            .when(F.col("kind").isin("heading", "list_text") & F.col("plain_shown").isNotNull(), F.concat("prefix", "plain_shown")).when(F.col("kind") == "other", F.col("text")))
    decision = F.when(F.col("kind") == "other", "copy").when(text.isNotNull(), "reuse").otherwise("translate")
    return rows.select(*keys, "line_no", text.alias("synced"), decision.alias("decision"))


def sections_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``section_no`` (0 before the first heading), ``heading``, ``nth`` of equal headings, and ``content`` of each section of lines."""
    w = W.partitionBy(*keys).orderBy("line_no")
    rows = lines.withColumn("__h", F.col("text").rlike(r"^#{1,10}\s+\S")).withColumn("section_no", F.sum(F.col("__h").cast("int")).over(w))
    out = rows.groupBy(*keys, "section_no").agg(
        F.coalesce(F.max(F.when(F.col("__h"), F.col("text"))), F.lit("")).alias("heading"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("__ls"))
    return out.select(*keys, "section_no", "heading", F.row_number().over(W.partitionBy(*keys, "heading").orderBy("section_no")).alias("nth"),
                      F.array_join(F.transform("__ls", lambda x: x["text"]), "\n").alias("content"))


def reconciled_sections(base: DataFrame, head: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """A ``decision`` per section of ``head`` lines: ``reuse`` the target's section ``target_no``, or ``translate``.

    A section is reused if the base has one of equal heading, the same in number among equals, and equal content, and the
    target as many sections as the base: then the target's section at the base's place is its translation.
    """
    b, h, t = (sections_of(x, keys) for x in (base, head, target))
    count = lambda x, name: x.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    even = count(b, "__n").join(count(t, "__m"), keys).where("__n = __m").select(*keys, F.lit(True).alias("__even"))
    old = b.select(*keys, "heading", "nth", F.col("content").alias("__old"), F.col("section_no").alias("__no"))
    rows = h.join(old, [*keys, "heading", "nth"], "left").join(even, keys, "left")
    same = F.coalesce((F.col("__old") == F.col("content")) & F.col("__even"), F.lit(False))
    return rows.select(*keys, "section_no", "heading", F.when(same, "reuse").otherwise("translate").alias("decision"), F.when(same, F.col("__no")).alias("target_no"))


def merged_maps(entries: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key of the union of maps: ``value``, the least, ``n_values`` and whether they are in ``conflict``; null values don't count."""
    return entries.groupBy(*keys).agg(F.min(value).alias("value"), F.count_distinct(value).alias("n_values")).withColumn("conflict", F.col("n_values") > 1)


def insertion_index(existing: DataFrame, new: DataFrame, keys: list[str], name: str, pos: str) -> DataFrame:
    """``at`` of each ``new`` name: the place of the first existing name, in the order of places, that is greater without regard to case; null if none is.

    One window over both in descending order carries the least place, so no pairs of names arise.
    """
    both = existing.select(*keys, F.upper(name).alias("__u"), F.lit(None).cast("string").alias("__n"), F.col(pos).alias("__p")).unionByName(
        new.select(*keys, F.upper(name).alias("__u"), F.col(name).alias("__n"), F.lit(None).cast(existing.schema[pos].dataType).alias("__p")))
    # Strictly greater: all rows of equal name are excluded by a range over the rank of names.
    ranked = both.withColumn("__r", F.dense_rank().over(W.partitionBy(*keys).orderBy(F.desc("__u"))))
    w = W.partitionBy(*keys).orderBy("__r").rangeBetween(W.unboundedPreceding, -1)
    return ranked.withColumn("at", F.min("__p").over(w)).where("__n IS NOT NULL").select(*keys, F.col("__n").alias(name), "at")
