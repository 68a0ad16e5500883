import random
from collections import Counter

from pyspark.sql import functions as F

from driftmark.operators import matching as J
from driftmark.operators import reports as R


def frame(spark, data):
    return spark.createDataFrame(data, "d int, v string, p int")


def test_multiset_positions(spark, rows):
    a = frame(spark, [(1, "x", 1), (1, "x", 2), (1, "y", 3), (1, None, 4)])
    b = frame(spark, [(1, "x", 7), (1, "y", 8), (1, "y", 9), (1, None, 5)])
    assert rows(J.multiset_positions(a, b, ["d"], "v", "p").select("left_pos", "right_pos")) == [(1, 7), (2, None), (3, 8), (4, None)]


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(2)
    a = [(rnd.randint(1, 3), rnd.choice("xyz"), i) for i in rnd.sample(range(100), 40)]
    b = [(rnd.randint(1, 3), rnd.choice("xy"), i) for i in rnd.sample(range(100), 40)]
    got = {(r.d, r.v, r.left_pos): r.right_pos for r in J.nearest(frame(spark, a), frame(spark, b), ["d"], "v", "p").collect()}
    want = {}
    for d, v, p in a:
        near = sorted((abs(q - p), q) for e, w, q in b if (e, w) == (d, v))
        if near:
            want[d, v, p] = near[0][1]
    assert got == want


def test_best_by_parents(spark, rows):
    schema = "d int, t string, ps array<string>, p int"
    a = spark.createDataFrame([(1, "x", ["a", "b"], 1), (1, "u", ["q"], 2), (1, "x", ["z"], 3)], schema)
    b = spark.createDataFrame([(1, "x", ["c", "b"], 5), (1, "x", ["a", "b"], 6), (1, "u", ["w"], 7)], schema)
    assert rows(J.best_by_parents(a, b, ["d"], "t", "ps", "p").select("left_pos", "right_pos", "score")) == [(1, 6, 2), (2, 7, 0)]


def test_multiset_overlap_equals_counters(spark):
    rnd = random.Random(4)
    a, b = ([(1, rnd.choice("abcd"), i) for i in range(30)] for _ in range(2))
    r = J.multiset_overlap(frame(spark, a), frame(spark, b), ["d"], "v").first()
    ca, cb = Counter(v for _, v, _ in a), Counter(v for _, v, _ in b)
    assert (r.common, r.left_only, r.right_only) == (sum((ca & cb).values()), sum((ca - cb).values()), sum((cb - ca).values()))


def test_unique_and_zip(spark, rows):
    a, b = frame(spark, [(1, "x", 1), (1, "y", 2), (1, "y", 3)]), frame(spark, [(1, "x", 4), (1, "y", 5)])
    assert rows(J.unique_key_join(a, b, ["d", "v"], "p")) == [(1, "x", 1, 4)]
    assert rows(J.zip_positions(a.drop("v"), b.drop("v"), ["d"], "p")) == [(1, 1, 4), (1, 2, 5)]


def test_terms(spark):
    df = spark.createDataFrame([(1, "The Query planner"), (2, None), (3, "")], "k int, t string")
    got = {r.k: r.matched for r in J.terms_in_text(df, "t", [("planner",), ("query planner",), ("PLANNER",), ("x",)], True).collect()}
    assert [x.lower() for x in got[1]] == ["query planner", "planner"] and not got[3]
    assert J.terms_in_text(df, "t", [], True).first().matched == []


def test_greedy_chunks_equal_a_loop(spark):
    rnd = random.Random(6)
    items = [(d, i, rnd.choice([0, 5, 50, 400])) for d in range(5) for i in range(30)]
    got = {(r.d, r.i): r.chunk_no for r in R.greedy_chunks(spark.createDataFrame(items, "d int, i int, n int"), ["d"], "i", "n", 4, 300).collect()}
    for d in range(5):
        no = n = s = 0
        for _, i, size in (x for x in items if x[0] == d):
            if n == 0 or n >= 4 or s + size > 300:
                no, n, s = no + 1, 0, 0
            n, s = n + 1, s + size
            assert got[d, i] == no


def test_ledger_and_summary(spark, rows):
    pending = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("c", "r1")], "path string, ref string")
    out = spark.createDataFrame([("a", "r2", "success"), ("b", "r2", "failed"), ("d", "r2", "partial"), ("e", "r2", None)], "path string, ref string, status string")
    assert rows(R.pending_ledger(pending, out, ["path"], "ref")) == [("b", "r1"), ("c", "r1"), ("d", "r2"), ("e", "r2")]
    assert tuple(R.status_summary(out).first()) == (1, 1, 1, 0, 3, False)
    assert R.status_summary(out.where("false")).first().all_done is True


def test_report_levels(spark):
    schema = "k int, additions int, deletions int, is_md boolean"
    t = spark.createDataFrame([(1, 5, 5, True), (2, 5, 5, True), (3, 50, 5, True), (4, 1, 1, True), (5, 1, 1, False)], schema)
    s = spark.createDataFrame([(1, 5, 5, True), (2, 6, 5, True), (3, 5, 5, True), (5, 1, 1, False)], schema)
    assert {r.k: r.level for r in R.report_levels(t, s, ["k"], 5).collect()} == {1: "exact", 2: "within", 3: "exceed", 4: "target_only", 5: ""}


def test_mapping_problems_and_keyed_changes(spark, rows):
    m = spark.createDataFrame([(1, 10, 2, 2), (2, 10, 2, 3), (3, None, 2, 2)], "s int, t int, source_level int, target_level int").withColumn("f", F.lit("f"))
    assert rows(R.mapping_problems(m, ["f"], "s", "t").select("s", "problem")) == [(1, "duplicate_target"), (2, "duplicate_target"), (2, "level_mismatch"), (3, "missing_target")]
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "k string, v string")
    b = spark.createDataFrame([("x", " 1 "), ("y", "3"), ("w", "1"), ("z", None)], "k string, v string")
    assert rows(R.keyed_changes(a, b, ["k"], "v")) == [("w", "added"), ("y", "modified")]
