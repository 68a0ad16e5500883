import pytest

from driftmark.llm import truncation as T

SCHEMA = "apply_id long, target_new_content string, source_new_content string, target_lang string, source_lang string, provider string, loaded_at int, units string, last string, reason string"
SENTENCES = ["The write buffer keeps up to {n} entries in memory before it contacts the job queue.", "Some operations, e.g. an update of the {e}, need additional permissions.",
             "Each {e} belongs to exactly one {f}.", "For small teams, one {e} with {n} workers is enough."]
NAMES = ["query planner", "network bridge", "cold tier", "storage node"]


def corpus():
    out = []
    for i in range(80):
        ss = [SENTENCES[(i + k) % 4].format(n=i + k, e=NAMES[(i + k) % 4], f=NAMES[(i * 3 + k) % 4]) for k in range(4)]
        text = "## Part\n\n" + " ".join(ss) + f"\n\n- Access to the {NAMES[i % 4]}\n- A copy of the {NAMES[(i + 1) % 4]}\n- At least {i} GB of memory\n\n" + ss[0]
        out.append((i, text, "Quelle."))
    return out


def cut(spark, cases):
    rows = [(i, t, s, "en", "de", "p", 1, "", "", "") for i, t, s in corpus()] + [(1000 + i, t, s, "en", "de", "q", 1, "", "", "") for i, (t, s) in enumerate(cases)]
    got = {r.apply_id: r.reason for r in T.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i] for i in range(80))
    return [got[1000 + i] for i in range(len(cases))]


def test_cuts_and_complete_texts(spark):
    ok, full = "Quelle.", corpus()[3][1]
    cases = [
        (full + " Each query planner bel", ok), (full + " Each query planner belongs to exactly", ok), (full + " Each query planner belongs to exactly [...]", ok), (full + " Some operations, e.g.", ok),
        (full + "\n\n- Access to the net", "- Zugang"), (full + "\n\n- Access to the", "- Zugang"), (full + "\n\n| a | b |\n|---|---|\n| x y |", "| x |"), (full + "\n\n```sql\nSELEC", "```\nx\n```"), (full + " Each query pl�", ok),
        (full, ok), (full + " \n\n", ok), (full[:-1], "Quelle"), (full + "\n\n- Access to the cold tier", "- Zugang zur Archivschicht"), (full + "\n\n```sql\nSELECT 1\n```\n", "```\nx\n```"),
        (full + "\n\n| a | b |\n|---|---|\n| x | y | \n", "| x |"), (None, ok), ("", ok), (" \n ", ok),
    ]
    got = cut(spark, cases)
    assert [bool(x) for x in got] == [True] * 9 + [False] * 9, got


def test_source_without_end_mark_leaves_the_ending_to_tell(spark):
    full = corpus()[5][1]
    assert [bool(x) for x in cut(spark, [(full + " Each query planner belongs to exactly one cold tier", "Ohne Ende"), (full + " Each query planner belongs to exactly one", "Ohne Ende")])] == [False, True]


def test_redelivery_nulls_and_rates(spark, rows):
    data = [(1, "A b", "Quelle.", "en", "de", "p", 1, "", "", ""), (1, "A b c.", "Quelle.", "en", "de", "p", 2, "", "", ""), (2, "Cut he", "Quelle.", None, None, None, 1, "", "", ""), (3, None, None, None, None, None, None, "", "", "")]
    got = T.truncated(spark.createDataFrame(data, SCHEMA))
    assert rows(got.select("apply_id", "cut")) == [(1, False), (2, True), (3, False)]
    assert rows(T.truncation_rates(got)) == sorted([("p", 1, 0, 0.0), (None, 2, 1, 0.5)], key=repr)


def test_empty_and_very_long(spark):
    assert T.truncated(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "One sentence here. " * 20000
    assert T.truncated(spark.createDataFrame([(1, text, "Q.", "en", "de", "p", 1, "", "", "")], SCHEMA)).first().cut is False


def test_trigrams_decide_and_the_source_only_vetoes(spark):
    full = corpus()[3][1]
    bare = full + " Each query planner belongs to exactly one cold tier"
    rows = [(i, t, s, "en", "de", "p", 1, "", "", "") for i, t, s in corpus()] + [(1000, bare, None, "en", "de", "q", 1, "", "", ""), (1001, bare, "Ohne Ende", "en", "de", "q", 1, "", "", "")]
    got = {r.apply_id: (r.reason, r.level) for r in T.truncated(spark.createDataFrame(rows, SCHEMA)).where("apply_id >= 1000").collect()}
    assert got == {1000: ("bare", "trigram"), 1001: (None, None)}


@pytest.mark.parametrize("tail", [" " * 10**6, " \n" * 300_000, " ..." * 200_000, " [cut]" * 100_000, "a-" * 300_000, "`" * 300_000, "(" * 300_000, "\u3000…" * 200_000])
def test_long_runs_neither_overflow_nor_rescan(spark, tail):
    for text in (f"Some words{tail}end.", f"Some words.{tail}"):
        assert T.truncated(spark.createDataFrame([(1, text, text, "en", "de", "p", 1, "", "", "")], SCHEMA)).count() == 1
