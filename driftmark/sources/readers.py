"""Readers: snapshots of files, configuration, glossaries, ledgers, name-status and multi-file patches. IDs: SRC1-SRC4 SRC6 SRC8 SRC10-SRC16 SNK2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.functions.markdown import name_status

CHANGED_FILE = T.StructType([T.StructField(c, T.StringType()) for c in ("filename", "status", "patch", "previous_filename")])
# Names of the four lists.
IGNORE_CONFIG = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in (
    "PR_MODE_IGNORE_FILES", "PR_MODE_IGNORE_FOLDERS", "COMMIT_BASED_MODE_IGNORE_FILES", "COMMIT_BASED_MODE_IGNORE_FOLDERS")])


def snapshot(spark: SparkSession, folder: str, ref: str, glob: str = "*.md") -> DataFrame:
    """``path`` (relative), ``ref`` and ``content`` of the files below a folder, one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/")
    return files.select(F.regexp_replace(F.col("path"), rf"^(?:file:/*)?/?\Q{root.lstrip('/')}\E/", "").alias("path"), F.lit(ref).alias("ref"), F.decode("content", "UTF-8").alias("content"))


def preferred(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Per key the value of the first source that has the key, in the order given; a null value still counts as had."""
    ranked = None
    for rank, df in enumerate(sources):
        part = df.select(*keys, F.struct(F.lit(rank).alias("rank"), F.col(value).alias("v")).alias("x"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy(*keys).agg(F.min("x").alias("x")).select(*keys, F.col("x.v").alias(value), F.col("x.rank").alias("source_rank"))


def glossary(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rows ``en``, ``target``, ``comment`` of a Markdown table of terms, from its lines; head and separator rows are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(text), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.trim(text).startswith("|")).select(cells.alias("c")).where("size(c) >= 2 AND NOT c[0] RLIKE '^:?-+:?$'")
    return rows.select(F.col("c")[0].alias("en"), F.col("c")[1].alias("target"), F.get("c", F.lit(2)).alias("comment")).where("lower(en) NOT IN ('en', 'english', 'term') AND en != ''")


def ledger_groups(ledgers: DataFrame) -> DataFrame:
    """Paths to retry per ref of ledgers ``target, sha, pending`` (a JSON object of path to ref); entries that aren't a commit id are dropped."""
    rows = ledgers.select("target", F.explode(F.from_json("pending", "map<string,string>")).alias("path", "ref")).where(F.col("ref").rlike("^[0-9a-f]{7,40}$"))
    return rows.groupBy("target", "ref").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def ignore_config(spark: SparkSession, path: str) -> DataFrame:
    """The four lists of a JSON configuration, with surrounding slashes gone; raises if a list is missing."""
    raw = spark.read.schema(IGNORE_CONFIG).option("multiLine", "true").json(path)

    def cleaned(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.transform(c, lambda x: F.regexp_replace(x, "^/+|/+$", ""))).alias(c)

    return raw.select(*[cleaned(c) for c in IGNORE_CONFIG.names])


def changed_files(listing: DataFrame, line: str = "value") -> DataFrame:
    """Files of a name-status listing."""
    return listing.where(F.trim(line) != "").select(name_status(F.col(line)).alias("s")).select("s.*")


def patches_of(diffs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``filename`` and ``patch`` per file of a diff of many files. A deleted file keeps its old name."""
    parts = F.expr(rf"filter(split(concat('\n', {text}), '\\n(?=diff --git )'), x -> startswith(x, 'diff --git '))")
    rows = diffs.select(*keys, F.explode(parts).alias("p"))
    new, old = F.regexp_extract("p", r"(?m)^\+\+\+ b/(.*)$", 1), F.regexp_extract("p", r"(?m)^--- a/(.*)$", 1)
    header = F.regexp_extract("p", r"^diff --git a/.* b/(.*)", 1)
    return rows.select(*keys, F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")), header).alias("filename"), F.regexp_extract("p", r"(?s)(?:^|\n)(@@.*)$", 1).alias("patch"))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root: not absolute, no parent steps, nothing in .git, no drive or NUL."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:|(?:^|[/\\])\.\.(?:[/\\]|$)|(?:^|[/\\])\.git(?:[/\\]|$)|\x00")
