import random

import pytest

from driftmark.operators import structure as S


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "d int, text string")


def lines(spark, *texts, **kw):
    return S.document_lines(docs(spark, *texts), ["d"], "text", **kw)


def in_fence(spark, text, fence):
    return [r.in_fence for r in lines(spark, text, fence=fence).orderBy("line_no").collect()]


def test_line_ends_empty_and_null(spark, rows):
    got = rows(lines(spark, "a\r\nb\rc\n", "", None).select("d", "line_no", "text"))
    assert got == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (0, 4, ""), (1, 1, "")]


@pytest.mark.parametrize("fence, inside", [("run_prefix", [1, 1, 1, 1, 0]), ("first_three", [1, 1, 0, 1, 1]), ("any_toggle", [1, 1, 0, 1, 1])])
def test_longer_opener(spark, fence, inside):
    assert in_fence(spark, "````\n```\n# x\n````\n# y", fence) == [bool(x) for x in inside]


def test_tilde_fence_and_trailing_text(spark):
    text = "~~~ x\n```\n~~~ y\nz"
    assert in_fence(spark, text, "commonmark") == [True] * 4
    assert in_fence(spark, text, "char_length") == [True, True, True, False]
    assert in_fence(spark, text, "backtick_toggle") == [False, True, True, True]


def test_unclosed_fence_hides_headings(spark):
    assert [r.level for r in lines(spark, "# a\n```\n# b").orderBy("line_no").collect()] == [1, 0, 0]


def test_hierarchy_equals_a_stack(spark):
    rnd = random.Random(5)
    levels = [[rnd.randint(1, 6) for _ in range(40)] for _ in range(6)]
    texts = ["\n".join("#" * n + f" t{i}" for i, n in enumerate(ls)) for ls in levels]
    ls = lines(spark, *texts)
    got = {(r.d, r.line_no): r.path for r in S.hierarchy(S.headings(ls, ["d"]), ["d"]).collect()}
    for d, own in enumerate(levels):
        stack = []
        for i, n in enumerate(own):
            while stack and stack[-1][0] >= n:
                stack.pop()
            path = [t for k, t in stack if k > 1] if n > 1 else []
            stack.append((n, "#" * n + f" t{i}"))
            assert got[d, i + 1] == " > ".join([*path, stack[-1][1]])


def test_section_ends(spark, rows):
    ls = lines(spark, "# a\nx\n## b\ny\n### c\nz\n## d")
    assert rows(S.section_ends(S.headings(ls, ["d"]), ls, ["d"]).drop("d", "level")) == [(1, 2, 2), (3, 4, 6), (5, 6, 6), (7, 7, 7)]


def test_heading_runs_and_first_difference(spark, rows):
    a = S.headings(lines(spark, "# a\n## b\n## c\n# d"), ["d"])
    assert rows(S.heading_runs(a, ["d"])) == [(0, "# -> ##x2 -> #")]
    both = spark.createDataFrame([(1, "s", 1, 1), (1, "s", 2, 2), (1, "t", 1, 1), (2, "s", 1, 1), (2, "t", 1, 1)], "d int, side string, pos int, level int")
    assert rows(S.first_heading_difference(both, ["d"], "side", "s", "t")) == [(1, 2, 2, None)]


def test_tag_balance_equals_a_stack(spark):
    rnd = random.Random(3)
    seqs = [[rnd.choice([1, -1]) for _ in range(rnd.randint(1, 9))] for _ in range(80)]
    texts = ["\n".join("<CustomContent p>" if s > 0 else "</CustomContent>" for s in q) for q in seqs]
    got = {r.d: (r.problem, r.problem_line) for r in S.tag_balance(S.tags(lines(spark, *texts), ["d"]), ["d"]).collect()}
    for d, q in enumerate(seqs):
        stack, bad = [], None
        for i, s in enumerate(q):
            if s > 0:
                stack.append(i + 1)
            elif stack:
                stack.pop()
            else:
                bad = i + 1
                break
        assert got[d] == (("unopened", bad) if bad else ("unclosed", stack[-1]) if stack else (None, None))


def test_blocks_are_lossless_up_to_blank_lines(spark):
    text = "# a\n\nx\ny\n\n```\n\n# no\n```\n\n\nz"
    got = [r.content for r in S.blocks(lines(spark, text), ["d"]).orderBy("block_no").collect()]
    assert got == ["# a", "x\ny", "```\n\n# no\n```", "z"]


def test_truncation_at_heading(spark, rows):
    from pyspark.sql import functions as F

    assert rows(S.truncate_at_heading(lines(spark, "# a\nx\n# b\ny"), ["d"], F.lit(1)).select("line_no")) == [(1,), (2,)]


def test_integrity_and_issues(spark, rows):
    data = spark.createDataFrame([(1, "s", "# a\n\n## b"), (1, "t", "# x\n\n# y"), (2, "s", "# a"), (2, "t", None)], "d int, side string, text string")
    ls = S.document_lines(data, ["d", "side"], "text")
    assert rows(S.structure_issues(ls, ["d"], "side", "s", "t")) == [(1, "heading_order", "# -> ##", "#x2")]
    assert rows(S.line_integrity(ls, ["d"], "side", "s", "t")) == [(1, 3, 3, True, True)]
