import pytest
import tiktoken

from driftmark.llm import tokens

SAMPLES = [
    None, "", " ", "a", "Hello world", "I'LL don't we've", " \n\n  a", "<|endoftext|> x", "naïve café 价格 1234 ²³ ﷺ௵⸻𝔘 👩‍👩‍👧‍👦", "a\r\n\tb c", "x" * 20000,
    "٣٤ ⅷ ​﻿", "\x00\x01\x7f", "_" * 300 + " end", "".join(map(chr, range(0x20, 0x250))),
]


@pytest.fixture(scope="module")
def bpe():
    return tokens.ByteBpe(tokens.default_vocabulary())


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.tokens)}, special_tokens={})


def test_ids_equal_another_encoder(bpe, reference):
    assert bpe.encode_batch(SAMPLES) == [reference.encode_ordinary(t) if t else [] for t in SAMPLES]
    assert bpe.count_batch(SAMPLES) == [len(x) for x in bpe.encode_batch(SAMPLES)]


def test_round_trip(bpe):
    for t in SAMPLES:
        assert bpe.decode(bpe.encode_batch([t])[0]) == (t or "")


def test_round_trip_random(bpe, reference):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=80))
    def check(t):
        ids = bpe.encode_batch([t])[0]
        assert ids == reference.encode_ordinary(t) and bpe.decode(ids) == t

    check()


def test_memo_may_overflow(bpe, monkeypatch, reference):
    monkeypatch.setattr(tokens, "MEMO_SIZE", 3)
    assert bpe.encode_batch(["a b c d e", "f g"]) == [reference.encode_ordinary("a b c d e"), reference.encode_ordinary("f g")]


def test_operator_edges(spark, rows):
    df = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "hi", "n"), (3, "hi", "n"), (None, "x", "n")], "id long, text string, ids string")
    got = rows(tokens.with_ids(df, "id", "text"))
    assert got == sorted([(1, []), (2, []), (3, [5303]), (3, [5303]), (None, [87])], key=repr)
    assert tokens.with_ids(df.limit(0), "id", "text").count() == 0
    back = rows(tokens.with_text(tokens.with_ids(df, "id", "text"), "id", "ids"))
    assert back == sorted([(1, ""), (2, ""), (3, "hi"), (3, "hi"), (None, "x")], key=repr)


def test_ranks_must_be_consecutive(tmp_path):
    (tmp_path / "v").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        tokens.read_ranks(str(tmp_path / "v"))
