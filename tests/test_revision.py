from pyspark.sql import functions as F

from driftmark.functions import markdown as M
from driftmark.operators import diffs as D
from driftmark.operators import revision as V


def test_match_in_phases(spark, rows):
    schema = "d int, p int, t string, s string"
    a = spark.createDataFrame([(1, 1, "x", "a"), (1, 2, "y", "b"), (1, 3, "y", "b"), (1, 4, "z", "q"), (1, 5, None, None)], schema)
    b = spark.createDataFrame([(1, 7, "x", "b"), (1, 8, "w", "b"), (1, 9, "v", "b"), (1, 10, "u", "q"), (1, 11, "u", "q")], schema)
    assert rows(V.match_sections(a, b, ["d"], "p", ["t", "s"])) == [(1, 1, 7, 1), (1, 2, 8, 2), (1, 3, 9, 2), (1, 4, 10, 2)]


def test_moves(spark, rows):
    schema = "d int, t string, u string, p int"
    a = spark.createDataFrame([(1, "x", "A", 1), (1, "y", "A", 2), (1, "z", None, 3)], schema)
    b = spark.createDataFrame([(1, "x", "B", 5), (1, "y", "A", 6), (1, "z", None, 7)], schema)
    assert rows(V.moved_sections(a, b, ["d"], "t", "u", "p")) == [(1, "x", "A", "B", "delete", 1), (1, "x", "A", "B", "insert", 5)]


def test_replacements(spark, rows):
    patch = "@@ -1,6 +1,6 @@\n-a\n-b\n+A\n+B\n x\n-c\n+C\n+D\n y\n-a\n+A"
    ops = D.operations(spark.createDataFrame([(1, patch)], "d int, patch string"), ["d"], "patch")
    assert rows(V.replacements(ops, ["d"]).select("old", "new", "n", "first_at")) == [("a", "A", 2, 1), ("b", "B", 1, 2)]


def test_runs(spark, rows):
    f = lambda vs: spark.createDataFrame([(k, v, i) for k, x in vs.items() for i, v in enumerate(x)], "d int, v string, p int")
    got = rows(V.find_runs(f({1: "ab", 2: "ab", 3: "ab"}), f({1: "xxaby", 2: "abab", 3: "ba"}), ["d"], "v", "p"))
    assert got == [(1, 3)]


def test_prefix_scope_and_folders(spark, rows):
    s, f = spark.createDataFrame([("abcdef1",), ("abcdef1234",), ("abc",)], "a string"), spark.createDataFrame([("abcdef12345",), ("abcdef99999",)], "b string")
    assert rows(V.by_prefix(s, f, "a", "b")) == [("abcdef1", "abcdef12345"), ("abcdef1234", "abcdef12345")]
    files = spark.createDataFrame([("new.md", "old.md"), ("x/y.md", None), ("xy.md", None), (None, None)], "filename string, previous_filename string")
    assert rows(V.in_scope(files, spark.createDataFrame([("old.md",), ("new.md",), ("q",), (None,)], "p string"), "p")) == [("new.md", "old.md")]
    assert V.without_folders(files, "filename", ["/x/", "", None]).count() == 3 and V.without_folders(files, "filename", []).count() == 4


def test_letter_blocks(spark, rows):
    base = spark.createDataFrame([(1, "A", "a"), (1, "C", "c"), (1, "D", "d")], "k int, l string, c string")
    change = spark.createDataFrame([(1, "B", "b"), (1, "C", "c2"), (1, "D", None)], "k int, l string, c string")
    assert rows(V.merge_blocks(base, change, ["k"], "l", "c")) == [(1, "a\nb\nc2")]


def test_external_failures_are_rows(spark):
    def shout(t):
        if t == "bad":
            raise ValueError("no")
        return t.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "k int, t string")
    assert [tuple(r)[2:] for r in V.call_external(df, "t", shout).orderBy("k").collect()] == [("A", "success", None), (None, "failed", "ValueError: no"), (None, "skipped", "no text")]


def test_text_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    text = "a <svg>1</svg> b <svg>2</svg> <svg>1</svg>" + "".join(f"<svg>{i}</svg>" for i in range(3, 14))
    x = M.strip_blocks(F.lit(text))
    assert value(F.size(x["blocks"])) == 13 and "<svg" not in value(x["text"]) and value(M.restore_blocks(x["text"], x["blocks"])) == text
    assert value(M.localized_links(F.lit("see https://d.example/a and https://d.example/zh/b, https://e.example/c"), "d.example", "zh")) == "see https://d.example/zh/a and https://d.example/zh/b, https://e.example/c"
    assert value(M.absolute_links(F.lit("[a](../x/y.md#z) [b](https://q/x.md) ![i](/m.png)"), "https://r/")) == "[a](https://r/y#z) [b](https://q/x.md) ![i](/m.png)"
    assert value(M.localized_aliases(F.lit("aliases: ['/a', '/zh/b']"), "/zh")) == "aliases: ['/zh/a','/zh/b']" and value(M.localized_aliases(F.lit("title: x"), "/zh")) == "title: x"
    assert value(M.json_object(F.lit('sure: {"a": "b"} ok'))) == {"a": "b"} and value(M.json_object(F.lit("none"))) is None
    assert value(M.fenced_list(F.lit("x\n```\n- a\n2. b\n\n```"))) == ["a", "b"] and value(M.fenced_list(F.lit("a\nb"))) == ["a", "b"]
    assert value(M.keep_indentation(F.lit("a\n  b\nc"), F.lit("  x\ny"))) == "  a\nb\nc"
    assert value(M.blank_before_headings(F.lit("a\n# b\n\n## c\nd"))) == "a\n\n# b\n\n## c\nd"
    assert value(M.section_key(F.lit("## What is new in v1.2.3 `x`"))) == "what is new in * x"
    assert [value(M.is_identifier_title(F.lit(t))) for t in ("max_size", "cache.level", "word", "two words")] == [True, True, False, False]


def test_every_diff_is_looked_up_by_its_digest(spark, rows, tmp_path):
    import hashlib

    from driftmark.plans import revisions

    spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 4)], "diff_id long").write.parquet(f"{tmp_path}/diff_file.parquet")
    assert rows(revisions.prefix_events(spark, str(tmp_path))) == sorted((hashlib.sha256(b"%d" % i).hexdigest()[:9], i) for i in (1, 2, 3, 4))


def test_credentials_in_properties_are_masked(spark, rows, tmp_path):
    from driftmark.plans import changes

    props = [(1, '{"url": "https://u:secret@h/x?token=abc&a=1"}'), (2, "Authorization: Bearer abc"), (3, '{"k": 1}'), (4, None)]
    spark.createDataFrame(props, "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(changes.redact(spark, str(tmp_path))) == sorted([(1, '{"url": "https://u:[REDACTED]@h/x?token=[REDACTED]&a=1"}'), (2, "Authorization: Bearer [REDACTED]"), (3, '{"k": 1}'), (4, None)], key=repr)
