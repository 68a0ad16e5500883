import itertools
import random

import pytest

from driftmark.llm import lookalikes as L


@pytest.fixture(scope="module")
def to_form():
    return L.Rewriter({})


SAME = [
    ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("ﬁle ﬂow ﬃ", "file flow ffi"), ("café", "café"), ("K", "K"), ("раgе", "page"), ("wοrkеrѕ", "workers"), ("a​b­c﻿", "abc"),
    ("a b c d", "a b c d"), ("⽤⼾", "用戶"), ("й", "й"), ("ё", "ë"), ("a\r\nb", "a\nb"), ("ệ", "ệ"), ("한", "한"), ("Ⅷ", "VIII"), ("\u212b", "\u00c5"), ("\u212b", "A\u030a"),
]
DIFFERENT = [("a", "A"), ("resume", "résumé"), ("x2", "x²"), ("1", "①"), ("a-b", "a–b"), ("𝔘", "U"), ("0", "O"), ("l", "1"), ("I", "l"), ("а б", "аб"), ("👩‍👩", "👩👩"), ("é", "è")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(to_form, a, b):
    assert to_form(a) == to_form(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(to_form, a, b):
    assert to_form(a) != to_form(b)


def test_ascii_is_kept_apart_and_forms_are_stable(to_form):
    chars = list(map(chr, range(32, 127)))
    assert len({to_form(c) for c in chars}) == len(chars)
    rnd = random.Random(1)
    pool = [m for a, b in SAME for m in a + b] + list("abc Ä é")
    for _ in range(300):
        t = "".join(rnd.choice(pool) for _ in range(12))
        assert to_form(to_form(t)) == to_form(t)


def test_frequency_chooses_the_representative():
    assert L.Rewriter({"а": 9, "a": 1})("a") == "а" and L.Rewriter({"a": 9, "а": 1})("а") == "a"
    assert L.Rewriter({"é": 1, "é": 5})("é") == "é"


def test_width_never_represents_and_empty_text_is_kept():
    r = L.Rewriter({"，": 99, ",": 1, "а": 9, "a": 1})
    assert r("a，b") == "а,b" and r("") == "" and not r._plain


def pairs(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, id string, form_key string")
    return sorted(map(tuple, L.look_alike_pairs(df, "doc_id", "text").collect()))


def test_pairs_against_brute_force(spark, to_form):
    rnd = random.Random(2)
    texts = ["page one", "раge one", "page оne", "page two", "page  two", "pаge two", None, "", " ", " "]
    data = [(i, rnd.choice(texts), "x", "y") for i in range(60)]
    want = [(a, b) for (a, s, *_), (b, t, *_) in itertools.combinations(data, 2) if s and t and s.strip() and t.strip() and s != t and to_form(s) == to_form(t)]
    assert pairs(spark, data) == sorted(want)


def test_hot_group_of_exact_copies_makes_no_pair(spark):
    assert pairs(spark, [(i, "same text", "x", "y") for i in range(500)]) == []


def test_edges(spark):
    assert pairs(spark, []) == []
    assert pairs(spark, [(1, "раge", "", ""), (1, "page", "", ""), (None, "page", "", ""), (2, "page", "", ""), (2, "page", "", "")]) == [(1, 2)]
    long = "слово " * 30000
    assert pairs(spark, [(1, long + "а", "", ""), (2, long + "a", "", "")]) == [(1, 2)]


def test_classes_and_forms(spark):
    df = spark.createDataFrame([(1, "page"), (2, "раge"), (3, "page"), (4, "other"), (5, None)], "doc_id long, text string")
    assert sorted(map(tuple, L.look_alike_classes_of(df, "doc_id", "text").collect())) == [(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2)]
    forms = {r.doc_id: r.form for r in L.consistent_forms(df, "doc_id", "text").collect()}
    assert forms[1] == forms[2] == forms[3] and forms[5] is None
    odd = spark.createDataFrame([(1, ""), (2, "раре а а а"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.form for r in L.consistent_forms(odd, "doc_id", "text").collect()} == {1: "", 2: "раре а а а", 3: None}


def test_strings_are_members_of_classes():
    _, strings = L.look_alike_classes()
    assert strings.find("\u212b") == strings.find("Å") == strings.find("A\u030a") and strings.find("ﬁ") == strings.find("fi") != strings.find("ﬂ")


def test_copies_beside_one_variant_are_linear(spark):
    import time

    from pyspark.sql import functions as F

    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "раge one").otherwise("page one").alias("text"))
    began = time.time()
    assert L.look_alike_pairs(rows, "doc_id", "text").count() == 99_999
    assert time.time() - began < 60
