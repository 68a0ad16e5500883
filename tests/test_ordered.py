from pyspark.sql import functions as F

from driftmark.operators import diffs as D
from driftmark.operators import ordered as O
from driftmark.operators import structure as S


def test_snapshot_diff_feeds_the_patch_reader(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\r\nB\r\nc\r\nd"), (2, "x", "x"), (3, None, "n")], "d int, a string, b string")
    got = O.snapshot_diff(df, "a", "b")
    assert {r.d: (r.additions, r.deletions) for r in got.collect()} == {1: (2, 1), 2: (0, 0), 3: (1, 1)}
    counts = {r.d: (r.additions, r.deletions) for r in D.line_counts(D.operations(got.select("d", "patch"), ["d"], "patch"), ["d"]).collect()}
    assert counts == {1: (2, 1), 3: (1, 1)}


def test_heading_pairs(spark, rows):
    far = "\n".join(f" c{i}" for i in range(10))
    patch = f"@@ -1,30 +1,30 @@\n-## Old name\n+## New title\n{far}\n-## Some section here\n{far}\n+## Some section there\n+## Unrelated"
    got = O.pair_headings(D.operations(spark.createDataFrame([(1, patch)], "d int, patch string"), ["d"], "patch"), ["d"])
    assert rows(got.select("old", "new")) == [("## Old name", "## New title"), ("## Some section here", "## Some section there")]
    assert O.pair_headings(D.operations(spark.createDataFrame([], "d int, patch string"), ["d"], "patch"), ["d"]).count() == 0


def test_forward_greedy_and_containment(spark, rows):
    f = lambda x: spark.createDataFrame(x, "d int, v string, p int")
    a, b = f([(1, "x", 1), (1, "y", 2), (1, "x", 3), (1, None, 4)]), f([(1, "x", 2), (1, "y", 5), (1, "x", 1)])
    assert rows(O.forward_greedy(a, b, ["d"], "v", "p")) == [(1, 1, 1), (1, 2, 5), (1, 3, 2)]
    a, b = f([(1, "query planner", 1), (1, "lock", 2), (1, "none", 3), (1, "", 4)]), f([(1, "planner", 7), (1, "lock manager", 8), (1, "lock", 9)])
    assert rows(O.exact_else_within(a, b, ["d"], "v", "p")) == [(1, 1, 7, "within"), (1, 2, 9, "exact")]


def test_sections_out_and_changes(spark, rows):
    def lines(t):
        return S.document_lines(spark.createDataFrame([(1, t)], "d int, t string"), ["d"], "t")

    text = "# A\na\n## See also\nx\n### sub\ny\n## B\nb\n## see also\nz"
    assert [r.text for r in O.without_sections(lines(text), ["d"], ["See also"]).orderBy("line_no").collect()] == ["# A", "a", "## B", "b"]

    def sections(t):
        ls = lines(t)
        h = S.hierarchy(S.headings(ls, ["d"]), ["d"]).select("d", F.col("line_no").alias("section_line"), "path")
        return S.section_contents(ls, ["d"]).join(h, ["d", "section_line"])

    got = O.section_changes(sections("# A\n## x\n1\n## y\n2\n## y\n3"), sections("# A\n## x\n1\n\n## y\n2\n## y\n4\n## z"), ["d"], "path", "content")
    assert rows(got.select("path", "nth", "operation")) == [("## y", 2, "modified"), ("## z", 1, "added")]


def test_levels_and_json(spark, rows):
    f = lambda x: spark.createDataFrame(x, "d int, line_no int, level int")
    got = O.repaired_levels(f([(1, 1, 1), (1, 5, 3), (2, 1, 1)]), f([(1, 2, 1), (1, 9, 2), (2, 1, 1), (2, 2, 2)]), ["d"], "line_no")
    assert rows(got) == [(1, 1, 1, 1), (1, 5, 3, 2)]
    df = spark.createDataFrame([('ok {"a": "b", "c": "d"}',), ('{"a": "b", "c": "d',), ('{"a": "b", "c',), ("no",), (None,)], "t string")
    assert [r[0] for r in df.select(O.json_prefix(F.col("t"))).collect()] == [{"a": "b", "c": "d"}, {"a": "b", "c": "d"}, {"a": "b"}, None, None]
