import pytest

from driftmark.llm import mixture

TARGET = "source string, weight double, max_repeat int"


def docs(spark, per):
    rows = [(i * 1000 + k, f"word{k} and more of it", s, "x") for i, (s, n) in enumerate(per) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")


def test_shares_and_caps(spark):
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], TARGET)
    m = mixture.mix(docs(spark, [("a", 600), ("b", 100), ("other", 50)]), t, total=mixture.EXACT)
    report = {r.source: r for r in m.report.collect()}
    assert report["b"].rate == 3.0 and not report["b"].limited and report["b"].n_copies == 300
    assert abs(report["a"].share - 0.5) < 0.06 and abs(sum(r.share for r in report.values()) - 1) < 1e-9
    assert m.sample.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    assert set(r.source for r in m.sample.select("source").distinct().collect()) == {"a", "b"}


def test_copies_are_floor_or_one_more_and_repeatable(spark, rows):
    t = spark.createDataFrame([("a", 0.7, 9), ("b", 0.3, 9)], TARGET)
    d = docs(spark, [("a", 200), ("b", 30)])
    one, two = mixture.mix(d, t), mixture.mix(d.repartition(7), t)
    assert rows(one.sample) == rows(two.sample)
    rates = {r.source: r.rate for r in one.rates.collect()}
    for r in one.sample.groupBy("source", "doc_id").count().collect():
        assert int(rates[r.source]) <= r["count"] <= int(rates[r.source]) + 1
    assert rows(mixture.mix(d, t, seed=1).sample) != rows(one.sample)


def test_given_total_reports_small_sources(spark):
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("none", 0.0, 1), ("gone", 0.1, 1)], TARGET)
    got = {r.source: r for r in mixture.mix(docs(spark, [("a", 400), ("b", 5)]), t, total=2000).report.collect()}
    assert got["b"].limited and got["b"].n_copies == 10 and got["gone"].limited and got["gone"].rate == 0
    assert not got["none"].limited and got["none"].n_copies == 0


@pytest.mark.parametrize("empty_docs, empty_target", [(True, False), (False, True), (True, True)])
def test_empty(spark, empty_docs, empty_target):
    t = spark.createDataFrame([] if empty_target else [("a", 1.0, 2)], TARGET)
    m = mixture.mix(docs(spark, [] if empty_docs else [("a", 3)]), t)
    assert m.sample.count() == 0 and m.report.count() == (0 if empty_target else 1)


def test_nulls_and_doubled_targets(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "some words here", "a"), (None, "some words here", "a"), (5, "x", None)], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.4, 2), ("a", 1.0, 1), (None, 1.0, 1), ("b", None, None)], TARGET)
    m = mixture.mix(d, t)
    got = {r.source: r for r in m.report.collect()}
    assert set(got) == {"a", "b"} and got["a"].rate == 1.0 and got["a"].share == 1.0 and m.sample.count() == 4


def test_default_total_uses_the_corpus_and_reports_what_is_too_small(spark):
    t = spark.createDataFrame([("a", 0.6, 3), ("b", 0.4, 3)], TARGET)
    got = {r.source: r for r in mixture.mix(docs(spark, [("a", 600), ("b", 20), ("other", 50)]), t).report.collect()}
    assert got["b"].limited and got["b"].rate == 3.0 and got["b"].n_copies == 60 and got["b"].share < 0.4
    assert not got["a"].limited and abs(got["a"].rate - 0.6 * (got["a"].n_tokens + got["b"].n_tokens) / got["a"].n_tokens) < 1e-6


@pytest.mark.parametrize("total", [None, mixture.EXACT])
def test_a_cap_of_zero_leaves_out_its_source_only(spark, total):
    t = spark.createDataFrame([("a", 0.6, 3), ("b", 0.4, 0)], TARGET)
    got = {r.source: r for r in mixture.mix(docs(spark, [("a", 50), ("b", 20)]), t, total=total).report.collect()}
    assert got["b"].limited and got["b"].n_copies == 0 and got["a"].n_copies > 0
