from driftmark.operators.compare import CopySpec, compare_copies

SPEC = CopySpec(keys=("k",), fields=("a", "t"), blank_insensitive=("t",), version="v")
SCHEMA = "k int, a int, t string, v int, field string, __side int"


def found(spark, left, right, rows):
    make = lambda data: spark.createDataFrame([(*r, "x", 9) for r in data], SCHEMA)  # noqa: E731  other columns clash with internal names
    return rows(compare_copies(make(left), make(right), SPEC).select("k", "field"))


def test_fields_missing_rows_and_blanks(spark, rows):
    left = [(1, 1, "a b", 1), (2, 5, "x", 1), (3, 1, "q", 1), (5, 1, None, 1)]
    right = [(1, 1, "ab", 1), (2, 6, "y", 1), (4, 1, "q", 1), (5, 1, "", 1)]
    assert found(spark, left, right, rows) == [(2, "a"), (2, "t"), (3, "missing_in_replica"), (4, "missing_in_primary"), (5, "t")]


def test_null_differs_from_zero_and_equals_null(spark, rows):
    assert found(spark, [(1, None, None, 1), (2, None, "u", 1)], [(1, 0, None, 1), (2, None, "u", 1)], rows) == [(1, "a")]


def test_latest_version_holds_and_repeats_do_not_count(spark, rows):
    left = [(1, 1, "a", 1), (1, 2, "a", 2), (1, 2, "a", 2), (1, 9, "a", None)]
    assert found(spark, left, [(1, 2, "a", 7)] * 3, rows) == []


def test_ties_are_settled_alike_on_both_sides(spark, rows):
    assert found(spark, [(1, 1, "a", 1), (1, 2, "a", 1)], [(1, 2, "a", 1), (1, 1, "a", 1)], rows) == []


def test_null_keys_and_hot_keys(spark, rows):
    hot = [(7, i, "t", i) for i in range(500)]
    assert found(spark, [(None, 1, "a", 1), *hot], [(None, 2, "a", 1), (7, 499, "t", 0)], rows) == [(None, "a")]


def test_empty_sides(spark, rows):
    assert found(spark, [], [], rows) == []
    assert found(spark, [(1, 1, "a", 1)], [], rows) == [(1, "missing_in_replica")]


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "a", 1)], "k int, a int, t string, v int")
    plan = compare_copies(df, df, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
