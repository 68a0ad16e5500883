"""Field-by-field comparison of two copies of one dataset (problem 3).

Both sides are tagged, united and grouped once by the key. Per key and side one struct is kept (the
valid version), by an aggregate that combines before the shuffle, so outdated versions, repeated
rows and hot keys cost no memory. Whether a field differs is decided by generated higher-order SQL
over the two structs. One shuffle in all, of one struct per key and side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every blank, also those that Java's \\s leaves out.
BLANKS = r"[\\s\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


@dataclass(frozen=True)
class CopySpec:
    """What two copies are compared by.

    keys: identify a record. fields: compared, in this order. blank_insensitive: those of ``fields``
    in which a difference in blanks alone doesn't count. version: the greatest value is the valid row.
    """

    keys: tuple[str, ...]
    fields: tuple[str, ...]
    blank_insensitive: tuple[str, ...] = field(default=())
    version: str = "loaded_at"


def _comparable(name: str, spec: CopySpec) -> str:
    return f"regexp_replace({{side}}.`{name}`, '{BLANKS}', '')" if name in spec.blank_insensitive else f"{{side}}.`{name}`"


def difference_sql(spec: CopySpec) -> str:
    """SQL for an array of the names of what differs between the structs ``__p`` and ``__r``."""
    checks = []
    for name in spec.fields:
        p, r = (_comparable(name, spec).format(side=s) for s in ("__p", "__r"))
        checks.append(f"named_struct('field', '{name}', 'differs', NOT ({p} <=> {r}))")
    fields = f"transform(filter(array({', '.join(checks)}), x -> x.differs), x -> x.field)"
    return (
        "CASE WHEN __p IS NULL THEN array('missing_in_primary') "
        f"WHEN __r IS NULL THEN array('missing_in_replica') ELSE {fields} END"
    )


def compare_copies(primary: DataFrame, replica: DataFrame, spec: CopySpec) -> DataFrame:
    """The keys with one row per ``field`` that differs, plus both values as text.

    ``field`` is ``missing_in_primary`` or ``missing_in_replica`` for a key that one side lacks.
    Null equals null only, so it differs from 0 and from the empty text. Null keys are keys. Of rows
    with equal version the greatest by the compared fields is valid, on both sides alike. Other
    columns, whatever their names, aren't read. An empty side makes every key of the other missing;
    two empty sides give no row.
    """
    parts = []
    for tag, df in ((0, primary), (1, replica)):
        parts.append(df.select(
            *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(spec.keys)],
            F.lit(tag).alias("__side"),
            F.struct(F.col(f"`{spec.version}`").alias("__version"), *[F.col(f"`{c}`").alias(c) for c in spec.fields]).alias("__row"),
        ))
    keys = [f"__k{i}" for i in range(len(spec.keys))]
    sides = parts[0].unionByName(parts[1]).groupBy(*keys).agg(
        F.max(F.when(F.col("__side") == 0, F.col("__row"))).alias("__p"),
        F.max(F.when(F.col("__side") == 1, F.col("__row"))).alias("__r"),
    )
    found = sides.select(*keys, "__p", "__r", F.explode(F.expr(difference_sql(spec))).alias("field"))

    def shown(side: str) -> Column:
        return F.coalesce(*[F.when(F.col("field") == c, F.col(f"{side}.`{c}`").cast("string")) for c in spec.fields])

    return found.select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(spec.keys)],
        "field", shown("__p").alias("primary_value"), shown("__r").alias("replica_value"),
    )


FILE_STATS = CopySpec(keys=("run_id", "path"), fields=("additions", "deletions"))
STRUCTURE_ISSUE = CopySpec(
    keys=("run_id", "file_path", "reason"), fields=("source_compact", "target_compact"),
    blank_insensitive=("source_compact", "target_compact"),
)
