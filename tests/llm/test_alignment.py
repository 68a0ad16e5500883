import random
import re
import zlib

import numpy as np
import pytest

from driftmark.llm import alignment as A
from driftmark.llm import sentences as S

MARKDOWN = [
    ("One. Two! Three?", [(0, "One."), (5, "Two!"), (10, "Three?")]), ("- Entry here.\n- no end", [(2, "Entry here.")]), ("> Quoted.\n> - Both.", [(2, "Quoted."), (14, "Both.")]),
    ("一。二！三", [(0, "一。"), (2, "二！")]), ("See v7.2.11 or 4.5 xy. Next.", [(0, "See v7.2.11 or 4.5 xy."), (23, "Next.")]), ("Some, e.g. an X, etc. but z. B. Eine.", [(0, "Some, e.g. an X, etc. but z. B. Eine.")]),
    ("# Head.\n| a. | b. |\n```\ncode. here.\n```\n<div>\nYes.", [(46, "Yes.")]), ("---\ntitle: x.\n---\nYes.", [(18, "Yes.")]), ("", []), ("no end", []), ("A.\r\nB.", [(0, "A."), (4, "B.")]), ("1. Step one.", [(3, "Step one.")]),
    ("重复。`x` 是。", [(0, "重复。"), (3, "`x` 是。")]), ("Use `a.b`. Then.", [(0, "Use `a.b`."), (11, "Then.")]),
]


@pytest.mark.parametrize("text, found", MARKDOWN)
def test_sentences(text, found):
    assert S.of_markdown(text) == found
    assert all(text[p:p + len(s)] == s for p, s in found)


def test_patch_sentences():
    patch = "@@ -1,2 +1,4 @@ Head.\n Context.\n-Old.\n+New one. And two.\n+## Head.\n+> Quote.\n+```\n+code.\n+```"
    got = S.of_patch(patch)
    assert [s for _, s in got] == ["New one.", "And two.", "Quote."] and all(patch[p:p + len(s)] == s for p, s in got)


WORDS = {"cat": "gato", "dog": "perro", "bird": "ave", "fish": "pez", "house": "casa", "tree": "arbol", "river": "rio", "stone": "piedra", "sleeps": "duerme", "runs": "corre", "eats": "come", "sings": "canta", "quickly": "pronto", "slowly": "despacio"}
NOUNS, VERBS, WAYS = list(WORDS)[:8], list(WORDS)[8:12], list(WORDS)[12:]


def made_up(seed, n, merges=True):
    """Documents in two languages with omissions, swaps and merges, and the true pairs of places."""
    rnd = random.Random(seed)
    docs, truth = [], set()
    for rec in range(n):
        items = []
        while len(items) < 8:
            x = (rnd.choice(NOUNS), rnd.choice(VERBS), rnd.choice(WAYS), rnd.choice(NOUNS), rnd.randint(10, 999) if rnd.random() < 0.5 else None)
            if x[:4] not in [y[:4] for y in items]:
                items.append(x)

        def say(x, tr):
            w = [WORDS[v] if tr else v for v in x[:4]]
            return f"{w[0]} {w[1]} {w[2]} {w[3]}" + (f" {x[4]}" if x[4] else "")

        src, at = "", {}
        for x in items:
            at[x] = len(src)
            src += say(x, False) + ". "
        keep = [x for x in items if rnd.random() < 0.85]
        if rnd.random() < 0.5:
            rnd.shuffle(keep)
        tgt, k = "", 0
        while k < len(keep):
            pair = keep[k:k + 2] if merges and rnd.random() < 0.15 else keep[k:k + 1]
            for x in pair:
                truth.add((rec, at[x], len(tgt)))
            tgt += ", y ".join(say(x, True) for x in pair) + ". "
            k += len(pair)
        # A sentence begins with a letter in upper case, else it doesn't end the one before.
        up = lambda t: t and ". ".join(p[:1].upper() + p[1:] for p in t.split(". "))
        docs.append(("t", rec, False, up(src), up(tgt), "en", "es"))
    return docs, truth


PAIRS = "tab string, rec_id bigint, patch boolean, source string, target string, source_lang string, target_lang string"


def test_held_out_accuracy(spark):
    docs, truth = made_up(1, 400)
    got = {(r.rec_id, r.src_start, r.tgt_start) for r in A.align_sentences(spark.createDataFrame(docs, PAIRS)).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95


def test_result_does_not_depend_on_partitions(spark):
    docs, _ = made_up(2, 60)
    df = spark.createDataFrame(docs, PAIRS)
    one, two = ({tuple(r) for r in A.align_sentences(x).collect()} for x in (df.coalesce(1), df.repartition(5)))
    assert len(one ^ two) <= 0.02 * len(one)


def test_edges(spark):
    df = spark.createDataFrame([("t", 1, False, None, "x.", "en", "es"), ("t", 2, False, "", "", None, None), ("t", 3, False, "No end", "x.", "en", "es"), ("t", 4, False, "Same `a_b`.", "Igual `a_b`.", None, None)], PAIRS)
    assert [tuple(r)[1:] for r in A.align_sentences(df).collect()] in ([(4, 0, 0)], [])
    assert A.align_sentences(df.limit(0)).count() == 0


def test_repeated_sentences_pair_in_order(spark):
    docs, _ = made_up(3, 150, merges=False)
    docs.append(("t", 999, False, "Cat sleeps slowly tree. Dog runs quickly stone 55. Cat sleeps slowly tree.", "Gato duerme despacio arbol. Perro corre pronto piedra 55. Gato duerme despacio arbol.", "en", "es"))
    got = sorted((r.src_start, r.tgt_start) for r in A.align_sentences(spark.createDataFrame(docs, PAIRS)).where("rec_id = 999").collect())
    assert got == [(0, 0), (24, 28), (51, 58)]


def test_inputs_of_tables(spark):
    d = spark.createDataFrame([(1, 7, "source", "A.", "en", 1), (2, 7, "target", "B.", "es", 1), (2, 7, "target", "C.", "es", 2), (3, 8, "source", "A.", "en", 1), (4, None, "source", "A.", "en", 1)],
                              "diff_id long, sync_id long, side string, patch string, lang string, loaded_at int")
    assert [(r.rec_id, r.source, r.target) for r in A.pairs_of_sides(d).collect()] == [(7, "A.", "C.")]
    assert A.language("zh-CN", []) == "zh" and A.language(None, ["Der Hund ist nicht da."]) == "de" and A.language(" ", ["行过滤器"]) == "zh" and A.language(None, []) == ""


def test_vectors_tell_ninety_translated_terms_apart():
    n = 90
    row, term = np.repeat(np.arange(n), 2), np.arange(2 * n)  # a row is a term and its translation
    idf, omega = np.ones(2 * n, np.float32), A._sketch_matrix()[:2 * n]
    terms, y = A.sketch_batch(row, term, np.ones(2 * n), idf, omega)
    v = A._unit(A.vectors_of(y.astype(np.float64), omega[terms], idf))
    assert np.abs(v[::2] @ v[1::2].T - np.eye(n)).max() < 0.05


def test_sentences_without_names_pair_from_the_least_cosine():
    a, b = np.array([[1.0, 0.0]], np.float32), np.array([[0.73, (1 - 0.73 ** 2) ** 0.5]], np.float32)
    assert A.align_document(a, b, [frozenset()], [frozenset()]) == [(0, 0)]


def test_a_short_distant_part_completes_a_window():
    # Lengths 1 and 0.3, cosines 0.7 and 0.24 with the sentence, orthogonal to one another: 0.739 together.
    a = np.array([[1.0, 0.0, 0.0]], np.float32)
    x = np.array([0.7, (1 - 0.7 ** 2) ** 0.5, 0.0])
    second = -0.7 * 0.24 / x[1]
    y = 0.3 * np.array([0.24, second, (1 - 0.24 ** 2 - second ** 2) ** 0.5])
    none = frozenset()
    assert A.align_document(a, np.array([x, y], np.float32), [none], [none, none]) == [(0, 0), (0, 1)]


def test_vectors_that_tell_nothing_pair_nothing():
    v, names = np.ones((6, 4), np.float32), [frozenset([k]) for k in range(6)]
    assert A.align_document(v, v, names, names, mean=np.full(4, 0.5, np.float32)) == []


def test_blocks_give_what_one_block_gives():
    rnd = np.random.default_rng(4)
    a = rnd.standard_normal((60, 12)).astype(np.float32)
    b = np.concatenate([a[rnd.permutation(60)] + 0.3 * rnd.standard_normal((60, 12)).astype(np.float32), a[:5]])
    na, nb = [frozenset([k % 3]) if k % 4 == 0 else frozenset() for k in range(60)], [frozenset()] * 65
    whole = A.align_document(a, b, na, nb)
    assert whole and sorted(whole) == sorted(A.align_document(a, b, na, nb, A.Thresholds(block=200)))


def test_vectors_carry_the_result_without_names(spark, monkeypatch):
    docs, truth = made_up(5, 400, merges=False)
    monkeypatch.setattr(A, "_names", lambda flat, counts: [frozenset()] * (len(counts) // 4))
    memo: dict = {}
    prepared = [(d[0], d[1], *A.prepare_one(d[3], d[4], d[5], d[6], False, memo)) for d in docs if d[4]]
    model = A.learn(spark.createDataFrame([(r[2], bytes(r[13]), bytes(r[14])) for r in prepared], "langs string, rows binary, row_size binary"))
    got = set()
    for r, pairs in A._Aligner(model)(prepared, A.Thresholds()):
        a, b = np.frombuffer(r[3], np.int32), np.frombuffer(r[8], np.int32)
        got |= {(r[1], int(a[i]), int(b[j])) for i, j in pairs}
    assert len(got & truth) / len(truth) > 0.9 and len(got & truth) / len(got) > 0.9


def test_unknown_languages_share_one_model():
    assert A.language("xx-YY", []) == A.language("tlh", []) == ""


def test_patterns_find_what_plain_ones_find():
    end = re.compile(r"[.!?]+[\"')»”’\]*_`]*(?=[ \t]|$)|[。！？]+[”’」』）]*")
    term = re.compile(r"\x00|`[^`\n\x00]+`|\d[\d.,]*\d|\d|[^\W\d_一-鿿]+|[一-鿿]+")
    rnd = random.Random(6)
    for _ in range(3000):
        t = "".join(rnd.choice(".!?。！？\"')”」_` \tabéßΩ中文12,_\x00٣") for _ in range(rnd.randint(0, 30)))
        assert [m.span() for m in S._END.finditer(t)] == [m.span() for m in end.finditer(t)]
        assert S._TERM.findall(t) == term.findall(t)


def test_code_cut_by_a_sentence_end_hides_no_sentence():
    assert [s for _, s in S.of_markdown("Use `a. B` here.")] == ["Use `a.", "B` here."]
    one = A.prepare_one("Use `a. B` here. See `c_d`.", "Use `a. B` aquí. Vea `c_d`.", "en", "es", False, {})
    assert np.frombuffer(one[2], np.int32).tolist() == [2, 2, 2] and np.frombuffer(one[5], np.int32).tolist() == [0, 0, 1]


def test_prepared_together_as_one_by_one():
    texts = ["", "no end", "Cat 12 sleeps `x_y` 12. Dog! 1,000 birds.", "Gato 12 duerme `x_y`. Perro! 1000 aves.", "猫在睡觉。狗 `x_y` 跑 12。", "+Added `q`. Two 7.\n Same.\n+Three.", "Zero\x00byte. <b>Bold</b> text.", "5. `only`. 7."]
    pairs = [(p, s, t, sl, None) for p in (False, True) for s in texts for t in texts for sl in (None, "en")]
    together = A.prepare_many(pairs, {})
    assert together == [A.prepare_one(s, t, sl, tl, p, {}) for p, s, t, sl, tl in pairs]
    for (p, s, t, _, _), one in zip(pairs, together):
        a, b = (S.of_patch(x) if p else S.of_markdown(x) for x in (s, t))
        assert (one is None) == (not a or not b)
        for side, found in ((1, a), (6, b)) if one else ():
            names, terms = [], []
            for _, sentence in found:
                each = [S.terms_of(x) for x in S.tokens([sentence])[:-1]]
                names.append(sorted({zlib.crc32(x.encode()) % (1 << 31) for name, xs in each if name for x in xs}))
                terms += [*(zlib.crc32(x.encode()) % A.BUCKETS for name, xs in each if not name for x in xs), A._STOP]
            assert np.frombuffer(one[side], np.int32).tolist() == [at for at, _ in found]
            assert np.frombuffer(one[side + 2], np.uint16).tolist() == terms
            assert [sorted(x) for x in A._names(one[side + 3], one[side + 4])] == names


def test_sums_hold_only_the_columns_of_their_own_languages(monkeypatch):
    docs, _ = made_up(8, 40)
    memo: dict = {}
    prepared = [(d[0], d[1], *A.prepare_one(d[3], d[4], lang, "es", False, memo)) for d in docs if d[4] for lang in ("en", "de")]
    rnd = np.random.default_rng(1)
    ids = np.unique(np.concatenate([np.frombuffer(r[k], np.uint16) for r in prepared for k in (5, 10)]))[:-1].astype(np.int32)
    model = {k: (ids, rnd.standard_normal((len(ids), 8)).astype(np.float32), np.zeros(8, np.float32)) for k in ("de-es", "en-es")}
    widths, products = [], A._products
    monkeypatch.setattr(A, "_products", lambda *x: (widths.append(len(w[2])) or w for w in products(*x)))
    both = {(r[1], r[2]): pairs for r, pairs in A._Aligner(model)(prepared, A.Thresholds())}
    assert len(both) == len(prepared) and max(widths) <= len(ids)
    assert both == {(r[1], r[2]): pairs for one in prepared for r, pairs in A._Aligner(model)([one], A.Thresholds())}


def test_cosines_of_a_text_in_one_block_are_made_once(monkeypatch):
    made, block = [], A._Scores.block
    monkeypatch.setattr(A._Scores, "block", lambda self, lo: made.append(lo) or block(self, lo))
    a = np.eye(6, dtype=np.float32)
    assert sorted(A.align_document(a, a, [frozenset()] * 6, [frozenset()] * 6)) == [(k, k) for k in range(6)] and made == [0]
