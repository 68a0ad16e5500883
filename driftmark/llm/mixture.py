"""Mixing sources to target weights, measured in tokens (problem 7).

Tokens are aggregated per source; the repetition rate of a source is target tokens over own tokens,
at most its cap. A document comes out floor(rate) times, plus once more with probability equal to
the fraction. That draw is a hash of seed, source and document id, so it needs no state, is the same
on every run and partitioning, and is independent of the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tokens import with_counts
from driftmark.runtime import checkpointed


#: As a total: the largest at which all shares are met exactly.
EXACT = "exact"


@dataclass(frozen=True)
class Mixture:
    """rates: one row per target source. sample: the documents with their copy number. report: shares reached."""

    rates: DataFrame
    sample: DataFrame
    report: DataFrame


def repetition_rates(per_source: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """The rate of each source of ``targets`` (source, weight, max_repeat) from ``per_source`` (source, n_docs, n_tokens).

    total: tokens the mixture should have. None takes as many as the target sources have together; ``EXACT`` the largest total
    at which every source that has tokens and may be used reaches its weight without exceeding its cap. A source that is too
    small for the total comes out at its cap, falls short and is reported so (``limited``); nothing is taken
    from others to fill up, which would distort their shares further. Sources without tokens, and those whose cap is 0, get rate
    0 and are limited; null weight counts as 0, null max_repeat as 1. A source listed twice counts
    once, with the greatest weight. The table of targets is small by nature: one row a source.
    """
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max(F.struct(F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeat", F.lit(1)).alias("m"))).alias("g")
    ).select("source", F.greatest(F.col("g.w"), F.lit(0.0)).alias("weight"), F.greatest(F.col("g.m"), F.lit(0)).alias("max_repeat"))
    joined = goal.join(per_source, "source", "left").select(
        "source", "weight", "max_repeat", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")
    )
    room = F.when((F.col("weight") > 0) & (F.col("n_tokens") > 0) & (F.col("max_repeat") > 0), F.col("max_repeat") * F.col("n_tokens") / F.col("weight"))
    whole = F.min(room) if total == EXACT else F.sum("n_tokens").cast("double") if total is None else F.lit(float(total))
    size = joined.agg(whole.alias("total_tokens"))
    wanted = F.coalesce(F.col("weight") * F.col("total_tokens"), F.lit(0.0))
    rate = F.when(F.col("n_tokens") > 0, F.least(wanted / F.col("n_tokens"), F.col("max_repeat").cast("double"))).otherwise(0.0)
    return joined.crossJoin(F.broadcast(size)).select(  # size is a single row
        "source", "weight", "max_repeat", "n_docs", "n_tokens", wanted.alias("wanted_tokens"),
        F.round(rate, 9).alias("rate"),
        ((F.col("weight") > 0) & (wanted > F.col("max_repeat") * F.col("n_tokens") * (1 + 1e-9))
         | (F.col("weight") > 0) & (F.col("n_tokens") == 0)).alias("limited"),
    )


def copies_sql(rate: str, seed: int, *keys: str) -> str:
    """SQL for the number of copies: floor(rate) plus a hash-seeded Bernoulli draw."""
    draw = f"(pmod(xxhash64({seed}, {', '.join(keys)}), 1000000007) + 0.5D) / 1000000007D"
    return f"CAST(floor({rate}) AS INT) + CASE WHEN {draw} < {rate} - floor({rate}) THEN 1 ELSE 0 END"


def mix(documents: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        total: int | str | None = None, seed: int = 20, vocabulary: str | None = None) -> Mixture:
    """The mixture that ``targets`` asks for.

    Texts are tokenised once, and only those of target sources; the counts are written to the shared
    checkpoint folder. The sample has a row per copy: ``id_col``, ``source``, ``n_tokens``, ``copy``
    (from 1). Null and empty texts have no tokens, so they can't change a share; they take part like
    any other. Rows of a null source never match. Rows repeated under one id are separate documents
    with one fate. Empty inputs give an empty sample and rates of 0.
    """
    # ``targets`` has one row a source; Spark checks its size against the broadcast threshold itself.
    named = targets.select("source").where("source IS NOT NULL").distinct()
    docs = documents.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("__text"))
    counted = checkpointed(with_counts(docs.join(named, "source", "left_semi"), ["__id", "source"], "__text", vocabulary))
    per_source = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rates = repetition_rates(per_source, targets, total)
    drawn = counted.join(rates.select("source", "rate"), "source").select(
        F.col("__id").alias(id_col), "source", "n_tokens", F.expr(copies_sql("rate", seed, "source", "__id")).alias("copies")
    ).where("copies > 0")
    sample = drawn.select(id_col, "source", "n_tokens", F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    reached = drawn.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_repeated"),
    )
    full = rates.join(reached, "source", "left").fillna(0, ["used_tokens", "n_copies", "most_repeated"])
    everything = full.agg(F.sum("used_tokens").alias("all_tokens"))
    report = full.crossJoin(F.broadcast(everything)).select(  # a single row
        "source", "weight", "max_repeat", "n_docs", "n_tokens", "rate", "limited", "n_copies", "most_repeated", "used_tokens",
        F.when(F.col("all_tokens") > 0, F.col("used_tokens") / F.col("all_tokens")).otherwise(0.0).alias("share"),
    )
    return Mixture(rates, sample, report)
