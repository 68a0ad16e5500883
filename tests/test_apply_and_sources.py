import pytest
from pyspark.sql import functions as F

from driftmark.functions import markdown as M
from driftmark.operators import apply as A
from driftmark.sources import readers
from driftmark.streaming import ledger


def test_edits(spark, rows):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(1, 7)] + [(2, 1, "only")], "d int, line_no int, text string")
    edits = [(1, 2, 3, "replace", "new"), (1, 5, 5, "delete", "ignored"), (1, 1, 1, "before", "top"), (1, 0, 0, "append", "end"), (3, 1, 1, "before", "nowhere")]
    got = rows(A.apply_edits(lines, spark.createDataFrame(edits, "d int, first_line int, last_line int, action string, text string"), ["d"]))
    assert got == [(1, "top\nl1\nnew\nl4\nl6\nend"), (2, "only")]


def test_reconcile_with_itself_reuses_all(spark):
    b = spark.createDataFrame([(1, 1, "# a"), (1, 2, "same"), (1, 3, "same"), (1, 4, "```\nx\n```"), (1, 5, "---")], "d int, p int, v string")
    got = [(r.decision, r.base_block_no) for r in A.reconcile_plan(b, b, ["d"], "v", "p").orderBy("block_no").collect()]
    assert got == [("reuse", 1), ("reuse", 2), ("reuse", 3), ("verbatim", 4), ("verbatim", 5)]


def test_marks(spark):
    df = spark.createDataFrame([("x\n# T\ny",), ("no heading",), ("# T <!-- c: old -->\nz",)], "t string")
    got = [r[0] for r in df.select(A.mark_document(F.col("t"), "c", F.lit("7"))).collect()]
    assert got == ["x\n# T <!-- c: 7 -->\ny", "<!-- c: 7 -->\nno heading", "# T <!-- c: 7 -->\nz"]


def test_start_line_ladder(spark):
    lines = spark.createDataFrame([(1, 1, "# a", 1), (1, 2, "x", 0), (1, 9, "## b", 2)], "d int, line_no int, text string, level int")
    s = spark.createDataFrame([(1, "e", 1, "# a"), (1, "o", 2, "# a"), (1, "f", 30, "## b"), (1, "n", 7, "## gone"), (1, "k", 50, "## gone")], "d int, section_id string, wanted_line int, heading string")
    assert {r.section_id: (r.resolved, r["rank"]) for r in A.start_line(s, lines, ["d"]).collect()} == {"e": (1, 1), "o": (1, 2), "f": (9, 3), "n": (9, 5), "k": (50, 6)}


def test_scalars(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert value(M.clean_title(F.lit("##  A `b` <span class=x>New</span> {#a-b}"))) == "A b"
    assert value(M.clean_title(F.lit(None).cast("string"))) == ""
    assert value(M.anchor_slug(F.lit("What is new in v4.0.10: `x` [link](y) & more!"))) == "what-is-new-in-v4010-x-link-more"
    assert value(M.path_key(F.lit("a/b--c%d.md"))) == "a--b%2D%2Dc%25d.md"
    assert value(M.redact(F.lit("https://u:pw@h/?token=abc Authorization: Bearer zzz"))) == "https://u:[REDACTED]@h/?token=[REDACTED] Authorization: Bearer [REDACTED]"
    assert value(M.set_heading_level(F.lit("## a\nb"), F.lit(9))) == "###### a\nb"
    assert tuple(value(M.repo_of_url(F.lit("https://h.example/o/r/pull/12/files/abcdef1..1234567")))) == ("o/r", 12, "abcdef1", "1234567")
    assert value(M.repo_of_url(F.lit("x"))).repo is None
    assert tuple(value(M.name_status(F.lit("R100\told.md\tnew.md")))) == ("renamed", "new.md", "old.md")
    assert [value(M.processing_type(F.lit(x))) for x in ("d/TOC.md", "a.PNG", "x.md", "y.txt")] == ["toc", "image", "markdown", "other"]
    assert value(M.links(F.lit("[a](/x/y.md#z) [b](../q.md) [c](http://e) [d](/x/y.md)"))) == ["x/y.md", "q.md"]


def test_readers(spark, rows, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# é\n")
    (tmp_path / "b.txt").write_text("no")
    assert rows(readers.snapshot(spark, str(tmp_path), "head")) == [("sub/a.md", "head", "# é\n")]
    a, b = (spark.createDataFrame(x, "p string, c string") for x in ([("x", "local")], [("x", "remote"), ("y", "remote")]))
    assert rows(readers.preferred([a, b], ["p"], "c")) == [("x", "local", 0), ("y", "remote", 1)]
    table = spark.createDataFrame([("| en | zh | c |",), ("|---|---|---|",), ("| row | 行 |  |",), ("text",)], "value string")
    assert rows(readers.glossary(table)) == [("row", "行", "")]
    led = spark.createDataFrame([("t", "s", '{"a": "abcdef1", "b": "abcdef1", "c": "bad"}')], "target string, sha string, pending string")
    assert rows(readers.ledger_groups(led)) == [("t", "abcdef1", ["a", "b"])]
    assert rows(readers.changed_files(spark.createDataFrame([("A\tx",), ("",), ("T\ty",)], "value string"))) == [("added", "x", None), ("modified", "y", None)]
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-a"
    assert rows(readers.patches_of(spark.createDataFrame([(1, diff)], "k int, t string"), ["k"], "t")) == [(1, "x", "@@ -1 +1 @@\n-a\n+b"), (1, "y", "@@ -1 +0,0 @@\n-a")]
    safe = [spark.range(1).select(readers.safe_path(F.lit(p))).first()[0] for p in ("a/b.md", "/a", "../a", "a/../../b", ".git/x", "", "a..b/c")]
    assert safe == [True, False, False, False, False, False, True]


def test_ignore_config(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text('{"PR_MODE_IGNORE_FILES": ["/a/"], "PR_MODE_IGNORE_FOLDERS": [], "COMMIT_BASED_MODE_IGNORE_FILES": [], "COMMIT_BASED_MODE_IGNORE_FOLDERS": []}')
    bad.write_text('{"PR_MODE_IGNORE_FILES": ["/a/"]}')
    assert readers.ignore_config(spark, str(good)).first().PR_MODE_IGNORE_FILES == ["a"]
    with pytest.raises(Exception, match="is missing"):
        readers.ignore_config(spark, str(bad)).collect()


def test_stream_is_idempotent(spark, rows, tmp_path):
    batch = spark.createDataFrame([(1, 5, "failed", 1), (1, 6, "success", 2), (2, 7, "partial", 3)], "path bigint, ref bigint, status string, seq bigint")
    folder = str(tmp_path / "v")
    for _ in range(2):
        ledger.merge_batch(batch, 0, folder)
    ledger.merge_batch(spark.createDataFrame([(2, 9, "success", 1), (3, 9, "failed", 1)], batch.schema), 1, folder)
    assert rows(spark.read.parquet(ledger.version_path(folder, 0))) == [(2, 7)]
    assert rows(spark.read.parquet(ledger.version_path(folder, 1))) == [(3, 9)]


def test_pages_with_comments_are_marked(spark, rows, tmp_path):
    from driftmark.plans import workflow

    pages = [(1, "# T\nx", 1), (2, "<!-- note -->\n# T\nx", 1), (3, "# T <!-- source-commit: old --> \nx", 1), (4, "<!-- source-commit: 9 -->\nx <!-- note -->", 1), (5, None, 1), (6, "a <!-- b -->", 1), (6, "# c", 2)]
    spark.createDataFrame(pages, "pair_id long, target_content string, loaded_at int").write.parquet(f"{tmp_path}/structure_pair.parquet")
    mark = "<!-- source-commit: %d -->"
    assert rows(workflow.page_marks(spark, str(tmp_path))) == [
        (1, f"# T {mark % 1}\nx"), (2, f"<!-- note -->\n# T {mark % 2}\nx"), (3, f"# T  {mark % 3}\nx"), (4, f"{mark % 4}\nx <!-- note -->"), (6, f"# c {mark % 6}")]
