import random
from collections import Counter

from driftmark.operators import diffs as D

PATCH = "--- a/x.md\n+++ b/x.md\n@@ -3,4 +3,5 @@ head\n a\n-b\n+b2\n+c\n d\n@@ -20,2 +21,1 @@\n-x\n y\n\\ No newline at end of file"


def ops(spark, *patches):
    return D.operations(spark.createDataFrame(list(enumerate(patches)), "d int, patch string"), ["d"], "patch")


def test_line_numbers(spark):
    got = [(r.op, r.old_line, r.new_line, r.content, r.hunk) for r in ops(spark, PATCH).orderBy("diff_index").collect()]
    assert got == [("context", 3, 3, "a", 1), ("deleted", 4, None, "b", 1), ("added", None, 4, "b2", 1), ("added", None, 5, "c", 1), ("context", 5, 6, "d", 1),
                   ("deleted", 20, None, "x", 2), ("context", 21, 21, "y", 2)]


def test_null_and_empty_patches(spark):
    assert ops(spark, None, "").count() == 0


def test_noop_pairs_equal_bags_per_block(spark):
    rnd = random.Random(1)
    texts, want = [], []
    for _ in range(30):
        lines, n, block = [], 0, []
        for _ in range(40):
            s = rnd.choice("+-  ")
            c = rnd.choice("abc")
            if s == " ":
                minus, plus = (Counter(x for t, x in block if t == k) for k in "-+")
                n += sum((minus & plus).values())
                block = []
            else:
                block.append((s, c))
            lines.append(s + c)
        minus, plus = (Counter(x for t, x in block if t == k) for k in "-+")
        want.append(n + sum((minus & plus).values()))
        texts.append("@@ -1,40 +1,40 @@\n" + "\n".join(lines))
    got = {r.d: r.noop_pairs for r in D.noop_pairs(ops(spark, *texts), ["d"]).collect()}
    assert [got.get(i, 0) for i in range(30)] == want


def test_ranges_groups_and_sections(spark, rows):
    patch = "@@ -1,3 +1,8 @@\n # top\n+## a\n+x\n y\n+z\n w\n w\n+q"
    o = ops(spark, patch)
    assert rows(D.changed_ranges(o, ["d"]).select("first_line", "last_line", "n")) == [(2, 5, 3), (8, 8, 1)]
    assert rows(D.insertion_groups(o, ["d"]).drop("d")) == [(1, 1, 2, 1, "# top")]
    assert rows(D.containing_sections(D.sides(o, ["d"]), ["d"]).drop("d")) == [(2, 4)]


def test_restructured(spark, rows):
    whole = "@@ -1,4 +1,4 @@\n-## a\n-x\n-## b\n-y\n+## c\n+x2\n+## d\n+y2"
    part = "@@ -1,4 +1,4 @@\n ## a\n-x\n+z\n ## b\n y"
    assert [r.restructured for r in D.restructured(D.sides(ops(spark, whole, part), ["d"]), ["d"]).orderBy("d").collect()] == [True, False]


def test_level_only(spark, rows):
    data = [(1, "## a\nx", "### a\nx\n"), (2, "## a\nx", "### a\ny"), (3, "## a", "## a"), (4, None, "# a")]
    assert rows(D.level_only_changes(spark.createDataFrame(data, "k int, o string, n string"), ["k"], "o", "n")) == [(1, 2, 3)]


def test_longest_common(spark):
    data = [(1, ["a", "b", "c"], ["c", "a", "b"]), (2, None, ["a"]), (3, [], [])]
    got = {r.k: r.lcs for r in D.longest_common(spark.createDataFrame(data, "k int, a array<string>, b array<string>"), ["k"], "a", "b").collect()}
    assert got == {1: 2, 2: 0, 3: 0}
