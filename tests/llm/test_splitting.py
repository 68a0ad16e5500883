import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmark.llm import splitting as P


def holds(text, limits):
    spans = P.split_spans(text, limits)
    assert "".join(text[c:e] for _, c, e, _ in spans) == text
    assert all(0 <= s <= c < e and e - s <= limits.max_chars and c - s <= limits.overlap for s, c, e, _ in spans)
    assert all(a[2] == b[1] for a, b in zip(spans, spans[1:]))
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#`é。-|+@", max_size=600), st.integers(5, 80), st.floats(0, 0.45))
def test_pieces_cover_the_text_within_limits(text, size, share):
    holds(text, P.Limits(size, int(size * share)))


@pytest.mark.parametrize("text", ["a" * 10000, "x\n" * 5000, " " * 9000, "字。" * 4000, "é" * 5000, "\n" * 7000, "```\n" + "c\n" * 5000])
def test_extremes(text):
    assert len(holds(text, P.Limits())) <= -(-(len(text) - 200) // 2800) + 2


def test_prefers_sections_and_keeps_fences(spark):
    rnd = random.Random(1)
    parts = [f"# part {i}\n" + "words here and there. " * rnd.randint(40, 60) + "\n\n" for i in range(12)]
    spans = holds("".join(parts), P.Limits())
    text = "".join(parts)
    assert all(text[e:].startswith("# ") for _, _, e, _ in spans[:-1])
    code = "intro\n\n```\n" + "line of code\n" * 60 + "```\n\n" + "prose. " * 350
    spans = holds(code, P.Limits())
    assert code[spans[0][2]:].startswith("prose") or spans[0][3] < P.BLOCK


def test_overlap_is_whole_lines(spark):
    text = "".join(f"line {i} {'y' * 60}\n" for i in range(100))
    for s, c, _, _ in P.split_spans(text)[1:]:
        assert 0 < c - s <= 200 and text[s - 1] == "\n"


def test_limits_are_checked():
    with pytest.raises(ValueError):
        P.Limits(100, 60)


def test_operators(spark):
    schema = "pair_id long, text string, v int, rec_id string, n_pieces string"
    rows = [(1, "a" * 7000, 1, "", ""), (1, "a" * 7000, 2, "", ""), (2, "a" * 7000, 1, "", ""), (2, "short", 2, "", ""), (3, None, 1, "", ""), (4, "", 1, "", ""), (None, "b" * 4000, 1, "", ""), (5, "x" * 3000, 1, "", ""), (6, "𝔘" * 3001, 1, "", "")]
    df = spark.createDataFrame(rows, schema)
    counts = {r.rec_id: r.n_pieces for r in P.piece_counts(df, "pair_id", "text", "v").collect()}
    assert counts == {1: 3, 2: 1, 3: 0, 4: 0, None: 2, 5: 1, 6: 2}
    pieces = P.split_texts(df, "pair_id", "text", "v").collect()
    assert sorted((r.rec_id or 0) for r in pieces) == [0, 0, 1, 1, 1, 2, 5, 6, 6]
    whole = "".join(r.piece[r.overlap:] for r in sorted((r for r in pieces if r.rec_id == 6), key=lambda r: r.piece_no))
    assert whole == "𝔘" * 3001
    assert P.split_texts(df.limit(0), "pair_id", "text", "v").count() == 0


def test_a_blank_line_alone_is_no_overlap():
    text = "x" * 400 + "\n\n" + "y" * 400
    assert P.overlap_start(text, 402, 0, 200) == 202 and P.overlap_start("a\nb\nc\n" * 100, 300, 0, 200) == 100
