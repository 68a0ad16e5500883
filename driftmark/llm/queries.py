"""Registered queries of the text operators, with SQL where SQL can express the whole operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import alignment, lookalikes, markup, mixture, splitting, tokens, truncation
from driftmark.runtime import latest_by, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "section_apply")).where("cut").select("apply_id")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(truncation.truncated(table(spark, d, "section_apply")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    docs = markup.found_kinds(table(spark, d, "documents"), "doc_id", "text", "source")
    pairs = markup.found_kinds(table(spark, d, "structure_pair"), "pair_id", "target_content", "repo", leave_out=("markdown",))
    return docs.select(F.lit("documents").alias("tab"), "rec_id", "kind").unionByName(pairs.select(F.lit("structure_pair").alias("tab"), "rec_id", "kind"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = markup.cleaned(table(spark, d, "documents"), "doc_id", "text").withColumn("tab", F.lit("documents"))
    pairs = latest_by(table(spark, d, "structure_pair"), ["pair_id"], "loaded_at", ["target_content"])
    return docs.unionByName(markup.cleaned(pairs, "pair_id", "target_content").withColumn("tab", F.lit("structure_pair")))


def p2_wrappers(spark: SparkSession, d: str) -> DataFrame:
    docs = markup.host_wrappers(table(spark, d, "documents"), "source", "text").withColumn("tab", F.lit("documents"))
    pairs = latest_by(table(spark, d, "structure_pair"), ["pair_id"], "loaded_at", ["target_content", "repo"])
    return docs.unionByName(markup.host_wrappers(pairs, "repo", "target_content").withColumn("tab", F.lit("structure_pair")))


_SPLIT = (("structure_pair", "pair_id", "target_content"), ("diff_file", "diff_id", "patch"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        splitting.piece_counts(table(spark, d, t), i, c, "loaded_at").where("n_pieces > 1").select(F.lit(t).alias("tab"), "rec_id")
        for t, i, c in _SPLIT
    ]
    return parts[0].unionByName(parts[1])


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = [splitting.split_texts(table(spark, d, t), i, c, "loaded_at").withColumn("tab", F.lit(t)) for t, i, c in _SPLIT]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = alignment.pairs_of_pages(table(spark, d, "structure_pair"))
    return alignment.align_sentences(pages.unionByName(alignment.pairs_of_sides(table(spark, d, "diff_file"))))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.with_ids(table(spark, d, "documents"), "doc_id", "text")


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_target")).sample


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_target")).report


def p7_exact_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_target"), total=mixture.EXACT).report


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_forms(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "form")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_alike_classes_of(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p2_found": p2_found, "p2_clean": p2_clean, "p2_wrappers": p2_wrappers, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p6_ids": p6_ids, "p7_sample": p7_sample, "p7_report": p7_report, "p7_exact_report": p7_exact_report, "p8_found": p8_found, "p8_forms": p8_forms, "p8_classes": p8_classes}
SQL: dict[str, str] = {
    "p4_found": "SELECT DISTINCT 'structure_pair' AS tab, pair_id AS rec_id FROM structure_pair WHERE length(target_content) > 3000 "
    "UNION ALL SELECT DISTINCT 'diff_file', diff_id FROM diff_file WHERE length(patch) > 3000",
}
