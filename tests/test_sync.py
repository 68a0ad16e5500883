import random

import pytest
from pyspark.sql import functions as F

from driftmark import runtime
from driftmark.functions import markdown as M
from driftmark.operators import diffs as D
from driftmark.operators import sync as Y
from driftmark.streaming import ledger

LINES = "k long, line_no int, text string"


def lines(spark, texts):
    return spark.createDataFrame([(k, i, x) for k, t in texts for i, x in enumerate(t.split("\n"))], LINES)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_hunk_lines_are_never_headers(spark):
    patch = "--- a/x.sql\n+++ b/x.sql\n@@ -3,4 +3,4 @@\n a\n--- old comment\n+-- new comment\n+++ y\n--- z\n c\n\\ No newline at end of file"
    got = [tuple(r)[2:] for r in D.operations(spark.createDataFrame([(1, patch), (2, None), (3, "")], "d long, p string"), ["d"], "p").orderBy("diff_index").select("d", "diff_index", "op", "old_line", "new_line", "head_line", "content").collect()]
    assert got == [("context", 3, 3, 3, "a"), ("deleted", 4, None, 4, "-- old comment"), ("added", None, 4, 4, "-- new comment"), ("added", None, 5, 5, "++ y"), ("deleted", 5, None, 6, "-- z"), ("context", 6, 6, 6, "c")]


def test_synced_lines(spark):
    base = "# Guide\n\n- [One](/a.md)\n- [Two](/b.md)\n- plain\n- [Three](/c.md)"
    target = "# 指南\n\n- [一](/a.md)\n- [二](/b.md)\n- 普通\n- [三](/c.md)"
    head = "# Guide\n\n- [Two](/b.md) {new}\n  - [One](/a.md)\n- [Tres](/c.md)\n- plain\n- other\n\n## Guide\ntext"
    got = [tuple(r) for r in Y.synced_lines(lines(spark, [(1, base)]), lines(spark, [(1, head), (2, "# Guide")]), lines(spark, [(1, target)]), ["k"]).orderBy("k", "line_no").select("synced", "decision").collect()]
    assert got == [("# 指南", "reuse"), ("", "copy"), ("- [二](/b.md) {new}", "reuse"), ("  - [一](/a.md)", "reuse"), (None, "translate"), ("- 普通", "reuse"), (None, "translate"), ("", "copy"), (None, "translate"), ("text", "copy"), (None, "translate")]


def test_synced_lines_of_equal_versions_give_the_target(spark):
    rnd = random.Random(1)
    base = "\n".join(f"- [t{i}](/{i}.md)" if i % 3 else f"- p{i}" for i in rnd.sample(range(60), 60))
    target = base.replace("t", "T").replace("p", "P").replace(".mD", ".md")
    got = Y.synced_lines(lines(spark, [(1, base)]), lines(spark, [(1, base)]), lines(spark, [(1, target)]), ["k"]).orderBy("line_no").collect()
    assert "\n".join(r.synced for r in got) == target and {r.decision for r in got} == {"reuse"}


def test_reconciled_sections(spark):
    base, head = "# A\nx\n## B\ny\n## B\nz", "# A\nx\n## B\nY\n## B\nz\n## C\nw"
    got = Y.reconciled_sections(lines(spark, [(1, base), (2, base)]), lines(spark, [(1, head), (2, head)]), lines(spark, [(1, "# a\nX\n## b\n1\n## b\n2"), (2, "# a")]), ["k"])
    assert [(r.k, r.section_no, r.decision, r.target_no) for r in got.orderBy("k", "section_no").collect()] == [
        (1, 1, "reuse", 1), (1, 2, "translate", None), (1, 3, "reuse", 3), (1, 4, "translate", None), *[(2, n, "translate", None) for n in (1, 2, 3, 4)]]


def test_maps_and_places(spark, rows):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", None)], "k string, v string")
    assert rows(Y.merged_maps(df, ["k"], "v")) == [("a", "1", 1, False), ("b", "1", 2, True), ("c", None, 0, False)]
    rnd = random.Random(2)
    old, new = [(rnd.randint(0, 2), f"{rnd.choice('abCD')}{rnd.randint(0, 9)}", i) for i in range(40)], [(rnd.randint(0, 3), f"{rnd.choice('ABcd')}{rnd.randint(0, 9)}", 0) for _ in range(30)]
    make = lambda x: spark.createDataFrame(x, "g int, name string, pos int")
    want = [(g, n, min((p for h, o, p in old if h == g and o.upper() > n.upper()), default=None)) for g, n, _ in new]
    assert rows(Y.insertion_index(make(old), make(new), ["g"], "name", "pos")) == sorted(want, key=repr)
    assert Y.insertion_index(make([]), make([]), ["g"], "name", "pos").count() == 0


SPACED = [
    ("a\n# b\n\n## c\nd", "a\n\n# b\n\n## c\nd"), ("```sh\necho 1\n# note\n```\n# h", "```sh\necho 1\n# note\n```\n\n# h"), ("# a\n# b\n# c", "# a\n\n# b\n\n# c"), ("x\n~~~\ny\n# z", "x\n~~~\ny\n# z"),
    ("a\n \n# b", "a\n \n# b"), ("", ""), (None, None), ("a\n#b\n###### c", "a\n#b\n\n###### c"),
]


@pytest.mark.parametrize("text, spaced", SPACED)
def test_blank_lines_before_headings(spark, text, spaced):
    assert value(spark, M.blank_before_headings(F.lit(text).cast("string"))) == spaced


VERBATIM = [("```\nx\n```", True), ("<CustomContent platform=\"a\">", True), ("<CustomContent a>\n\n</CustomContent>", True), ("<CustomContent a>\ntext\n</CustomContent>", False), ("12 -- 3", True), ("word", False), ("<b>", False)]


@pytest.mark.parametrize("block, verbatim", VERBATIM)
def test_verbatim_blocks(spark, block, verbatim):
    assert value(spark, M.is_verbatim(F.lit(block))) is verbatim


SECRETS = [
    ("https://u:pw@h/?token=abc Authorization: Bearer zzz", "https://u:[REDACTED]@h/?token=[REDACTED] Authorization: Bearer [REDACTED]"), ("x-access-token:abc@h", "x-access-token:[REDACTED]@h"),
    ('{"api_key": "abc", "n": 1}', '{"api_key": "[REDACTED]", "n": 1}'), ("PASSWORD=a&b=1", "PASSWORD=[REDACTED]&b=1"), ("client_secret: s3", "client_secret: [REDACTED]"), ("the token is here", "the token is here"),
    ("https://h:80/x", "https://h:80/x"), ("sesame and my-sesame", "[REDACTED] and [REDACTED]"), (None, None), ("", ""),
]


@pytest.mark.parametrize("text, hidden", SECRETS)
def test_redaction(spark, text, hidden):
    assert value(spark, M.redact(F.lit(text).cast("string"), ("sesame", "my-sesame", ""))) == hidden


SLUGS = [("What is new in v4.0.10: `x` [link](y) & more!", "what-is-new-in-v4010-x-link-more"), ("A `b`c {#own}", "a-bc"), ("一 x", "x"), ("", ""), ("<b>x</b>y", "x-y"), ("a_b--c", "a-b-c"), (None, None)]


@pytest.mark.parametrize("title, slug", SLUGS)
def test_slugs(spark, title, slug):
    assert value(spark, M.anchor_slug(F.lit(title).cast("string"))) == slug


def test_tags_come_back_or_not_at_all(spark):
    text = "<A x>one</A> two <B/>"
    x = spark.createDataFrame([(text,), ("none",)], "t string").withColumn("p", M.protect_tags(F.col("t")))
    back = lambda c: [r[0] for r in x.select(M.restore_tags(c, F.col("p.tags"), F.col("p.nonce"))).collect()]
    assert back(F.col("p.text")) == [text, "none"] and back(F.reverse("p.text"))[0] is None and back(F.concat("p.text", "p.text"))[0] is None
    assert back(F.regexp_replace("p.text", ":1⟧", ":2⟧"))[0] is None


REPLIES = [("```markdown\n# a\n```", "# a"), ("```\na\n```\nb\n```\nc\n```", "```\na\n```\nb\n```\nc\n```"), ("plain", "plain"), ("```md\nx\n```sh\ny\n```\nz\n```", "x\n```sh\ny\n```\nz"), (None, None)]


@pytest.mark.parametrize("reply, text", REPLIES)
def test_wrapping_fences(spark, reply, text):
    assert value(spark, M.unwrapped_fence(F.lit(reply).cast("string"))) == text


PAGES = [("---\ntitle: x\n# c\n---\n```\n# x\n```\ntext", True), ("text\n# h", False), ("", True), (None, None), ("~~~\n# x", True)]


@pytest.mark.parametrize("page, without", PAGES)
def test_pages_without_headings(spark, page, without):
    assert value(spark, M.is_headingless(F.lit(page).cast("string"))) is without


def test_wrapper_lines(spark):
    got = [value(spark, M.is_wrapper_line(F.lit(x))) for x in ("<Tabs>", " </Tabs> ", "<Tab name=\"x\">", "<Tab/>", "<tab>", "a <Tab>", "")]
    assert got == [True, True, True, False, False, False, False]


def test_a_missing_ledger_is_an_error(spark, tmp_path):
    folder = f"{tmp_path}/ledger"
    batch = spark.createDataFrame([(1, 1, "failed", 1)], "path long, ref long, status string, seq long")
    with pytest.raises(FileNotFoundError):
        ledger.merge_batch(batch, 3, folder)
    ledger.merge_batch(batch, 0, folder)
    ledger.merge_batch(spark.createDataFrame([(1, 2, "success", 2), (2, 2, "failed", 2)], batch.schema), 1, folder)
    assert [tuple(r) for r in spark.read.parquet(ledger.last_version(spark, folder)).collect()] == [(2, 2)]


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError):
        runtime.shared_folder(Session)


def test_heading_prefixes(spark, rows):
    patch = "@@ -1,1 +1,14 @@\n a\n+text\n+\n+<CustomContent a>\n+\n+## One\n+\n+\n+<CustomContent b>\n+## Two\n+<CustomContent c>\n x\n+## Three\n+## Four"
    got = rows(D.heading_prefixes(D.operations(spark.createDataFrame([(1, patch), (2, "")], "d long, p string"), ["d"], "p"), ["d"]))
    assert got == sorted([(1, 6, 4, 2, 3), (1, 10, 9, 1, 2)], key=repr)
