"""Joins that pair rows of two documents: by key and rank, distance, suffix or order.

IDs: JOIN1-JOIN5, JOIN7, JOIN8, JOIN10-JOIN16, JOIN19, SET1-SET4. Every join has an equality key, so none is a
cross join; ties are settled by windows within the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def multiset_positions(left: DataFrame, right: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Left rows with ``left_pos`` and ``right_pos``: the nth occurrence of a value takes the nth on the right, or null. Null values match nothing."""
    rank = F.row_number().over(W.partitionBy(*keys, value).orderBy(pos))
    a = left.select(*keys, value, F.col(pos).alias("left_pos"), rank.alias("__n"))
    b = right.select(*keys, value, F.col(pos).alias("right_pos"), rank.alias("__n"))
    return a.join(b, [*keys, value, "__n"], "left").select(*keys, value, "left_pos", "right_pos")


def zip_positions(left: DataFrame, right: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The nth row on the left with the nth on the right, as far as both reach."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(pos))
    a = left.select(*keys, *[F.col(c).alias(f"left_{c}") for c in left.columns if c not in keys], rank.alias("__n"))
    b = right.select(*keys, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys], rank.alias("__n"))
    return a.join(b, [*keys, "__n"]).drop("__n")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Each left row with the right row of equal value at the least distance; of equally distant ones the earlier.

    Not the pairs of equal values but two window lookups: the last match at or before and the first after, so a
    value that fills a document costs no quadratic work.
    """
    a = left.select(*keys, value, F.col(pos).alias("__p"), F.lit(1).alias("__side"))
    b = right.select(*keys, value, F.col(pos).alias("__p"), F.lit(0).alias("__side"))
    order = W.partitionBy(*keys, value).orderBy("__p", "__side")
    found = F.when(F.col("__side") == 0, F.col("__p"))
    before = F.last(found, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(found, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    rows = a.unionByName(b).withColumn("__b", before).withColumn("__a", after).where("__side = 1")
    best = F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("__a")).when(
        F.col("__a") - F.col("__p") < F.col("__p") - F.col("__b"), F.col("__a")).otherwise(F.col("__b"))
    return rows.select(*keys, value, F.col("__p").alias("left_pos"), best.alias("right_pos")).where("right_pos IS NOT NULL")


def suffix_score(a: Column, b: Column) -> Column:
    """How many trailing elements two arrays share."""
    pairs = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct(
        F.when(s["on"] & x, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def best_by_parents(left: DataFrame, right: DataFrame, keys: list[str], title: str, parents: str, pos: str) -> DataFrame:
    """Left rows with the right row of equal title whose parents agree longest from the end.

    A title that is unique on the right needs no agreement; one that isn't needs at least one parent in common. Ties go to the first.
    """
    a = left.select(*keys, title, F.col(pos).alias("left_pos"), F.col(parents).alias("__pa"))
    b = right.select(*keys, title, F.col(pos).alias("right_pos"), F.col(parents).alias("__pb"), F.count(F.lit(1)).over(W.partitionBy(*keys, title)).alias("__n"))
    scored = a.join(b, [*keys, title]).withColumn("score", suffix_score(F.col("__pa"), F.col("__pb"))).where("__n = 1 OR score > 0")
    best = scored.groupBy(*keys, title, "left_pos").agg(F.max(F.struct("score", (-F.col("right_pos")).alias("p"))).alias("b"))
    return best.select(*keys, title, "left_pos", (-F.col("b.p")).alias("right_pos"), F.col("b.score").alias("score"))


def unique_key_join(left: DataFrame, right: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Pairs by keys that are unique on both sides."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    a = left.withColumn("__n", n).where("__n = 1").select(*keys, F.col(pos).alias("left_pos"))
    return a.join(right.withColumn("__n", n).where("__n = 1").select(*keys, F.col(pos).alias("right_pos")), keys)


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sizes of two bags, of their intersection and of both differences, per key. One shuffle, combined before it."""
    both = left.select(*keys, value, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, value, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.groupBy(*keys, value).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per.groupBy(*keys).agg(
        F.sum("l").alias("left_size"), F.sum("r").alias("right_size"), F.sum(F.least("l", "r")).alias("common"),
        F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("left_only"), F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("right_only"))


def terms_in_text(texts: DataFrame, text: str, terms: list[tuple], case_insensitive: bool) -> DataFrame:
    """Texts with ``matched``: the terms they contain, longest first, at most one per lower-cased term.

    One automaton of all terms runs over each text once, whatever their number; it is built once a task and nothing is
    joined. Terms come from a glossary, whose size doesn't grow with the texts. Null texts match none.
    """
    ordered = sorted({t.lower(): t for t in sorted(x for x, in terms) if len(t) >= 2}.values(), key=lambda t: (-len(t), t.lower()))
    if not ordered:
        return texts.withColumn("matched", F.array().cast("array<string>"))
    hay = F.lower(F.col(text)) if case_insensitive else F.col(text)
    rows = texts.withColumn("__hay", hay)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)

    def match(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for k, t in enumerate(ordered):
            automaton.add_word(t.lower() if case_insensitive else t, k)
        automaton.make_automaton()
        for b in batches:
            found = [[ordered[k] for k in sorted({k for _, k in automaton.iter(t)})] if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.string()))], [*b.schema.names[:-1], "matched"])

    return rows.mapInArrow(match, f"{fields}, matched array<string>")
