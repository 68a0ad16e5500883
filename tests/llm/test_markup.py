import random

import pytest
from pyspark.sql import functions as F

from driftmark.llm import markup as M
from driftmark.llm import queries as Q
from driftmark.llm import wrappers as W

KINDS = [
    ("plain text, nothing else.", []), ("", []), (None, []), ("a < b and c > d & e", []), ("The price rose from $35 to $69 per month.", []), ("Log in as <user-name> at <cluster-name>.", []),
    ("Ticket #4162 and list[0] in file_3254_old.txt", []), ("C:\\data\\new_142 and D:\\temp", []), ("- one\n- two\n\n1. x\n2) y\n• z\n– q", []), ("2 * 3 * 4 equals 24; a {placeholder} -> ^C", []),
    ("snake_case_name and __init__py5 ~5 % (p<0.05)", []), ("R&D and Q&A; AT&T;", []), ("<CustomContent platform=\"x\">\ntext\n</CustomContent>", []), ("C# or F#, rate == 5 holds", []),
    ("an <b>update</b> of", ["html"]), ("</p> stray", ["html"]), ("x&nbsp;.", ["html"]), ("x &#160; y", ["html"]), ("<img alt=\"\" src=\"/m.png\" width=.", ["html"]), ("a <!-- c --> b", ["html"]), ("<BR>", ["html"]),
    ("# Title\n\ntext", ["markdown"]), ("Title\n=====\n\ntext", ["markdown"]), ("some **bold** word", ["markdown"]), ("每`个许`可", ["markdown"]), ("see [x](/y.md)", ["markdown"]), ("a note[^3].", ["markdown"]),
    ("|a|b|\n|---|:--:|\n|1|2|", ["markdown"]), ("> quoted", ["markdown"]), ("```\n<b> \\frac{a}{b} [[x]]\n```", ["markdown"]), ("~~gone~~", ["markdown"]), ("__por__ qué", ["markdown"]),
    ("== Head ==\n\n# numbered\n* item", ["wiki"]), ("back [[users|to]] x", ["wiki"]), ("''x''", ["wiki"]), ("{{cite|t=a}}", ["wiki"]), ("[https://e.example/x word] y", ["wiki"]), ("{|\n! a !! b\n|-\n| c || d\n|}", ["wiki"]),
    ("\\section{A}", ["latex"]), ("{\\bf word}", ["latex"]), ("about 45.6\\% of", ["latex"]), ("is ($n_{j} \\le 17$)", ["latex"]), ("\\(O(k \\log n)\\)", ["latex"]), ("\\[ a^2 = b \\]", ["latex"]), ("\\newpage", ["latex"]),
    ("x\n% end of notes", ["latex"]), ("$$\nx + 1\n$$", ["latex"]), ("\\begin{verbatim}\n<b> [[x]] # y\n\\end{verbatim}", ["latex"]), ("<pre><code># step [[x]] \\frac{a}{b}</code></pre>", ["html"]),
    ("# T\n\nan <b>x</b> and [[y]] and \\emph{z}", ["html", "markdown", "wiki", "latex"]),
]


@pytest.mark.parametrize("text, kinds", KINDS)
def test_kinds(text, kinds):
    assert M.kinds(text) == kinds


CLEAN = [
    ("<h2 class='x'>Head</h2>\n<p>One &amp; two<br>three</p><ul><li>a</li><li>b</li></ul>", "## Head\n\nOne & two\nthree\n\n- a\n- b"),
    ("== Head ==\n\nThe ''x'' of [[a|b]] {{note}}.\n\n# one\n# two\n\n code here\n\n[[Category:z]]", "# Head\n\nThe x of b.\n\n1. one\n1. two\n\n```\ncode here\n```"),
    ("\\section*{Head}\\label{s}\n\n\\begin{itemize}\n  \\item a \\textbf{b}\n\\end{itemize}\n5\\% of $x_1$", "# Head\n\n- a b\n\n5% of $x_1$"),
    ("# A\n\nsome **bold** [x](y) `c*d*`[^1]\n\n```sql\nSELECT *\n```\n* i", "# A\n\nsome bold x c*d*\n\n```sql\nSELECT *\n```\n\n- i"),
    ("|a|b|\n|---|---|\n|1|2|", "|a|b|\n|1|2|"), ("plain", "plain"), ("", ""), (None, None),
]


@pytest.mark.parametrize("text, clean", CLEAN)
def test_clean(text, clean):
    assert M.clean(text) == clean


def test_cleaning_leaves_no_markup_but_structure():
    for text, kinds in KINDS:
        if kinds and "markdown" not in kinds:
            left = set(M.kinds(M.clean(text)))
            assert not left & {"html", "wiki"}, (text, M.clean(text))


def test_very_long_and_hostile_texts():
    for t in ("<" * 20000, "`" * 20001, "[" * 20000, "$" * 20001, "{{" * 9000, "'" * 20000, "*" * 20000, "# x\n" * 20000, "<b>" * 20000, "\\" * 20000, "==" * 9000, "_a" * 10000):
        M.kinds(t)


def test_wrappers_accept_what_they_were_inferred_from():
    rnd = random.Random(7)
    for _ in range(60):
        pages = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 25))]
        w = W.infer(map(W.page, pages))
        assert all(W.accepts(w, p) for p in pages), (W.show(w), pages)
        parts = W.infer(W.infer(map(W.page, pages[k::3])) for k in range(3) if pages[k::3])
        assert all(W.accepts(parts, p) for p in pages)
        assert W.loads(W.dumps(w)) == w


def test_wrapper_of_a_template():
    w = W.infer(map(W.page, ["h # li # li # end", "h # li # end", "h # li # li # li # note # end"]))
    assert W.show(w) == "h # (li #)+ (note)? (#)? end" or W.accepts(w, "h # li # li # li # li # end")



def test_mismatches_fold_into_repeated_groups():
    one, two = W.page("li #"), W.page("li # li #")
    assert W.show(two) == W.show(W.align(one, two)) == W.show(W.align(two, one)) == "(li #)+"
    assert W.show(W.align(("h", "li", "#", "x"), ("h", "li", "#", "li", "#", "x"))) == "h (li #)+ x"
    long = "a b c d e f g h i j k"
    assert W.show(W.page(f"{long} {long} {long}")) == f"({long})+"


def test_many_optionals_keep_their_order():
    labels = [f"t{i}" for i in range(30)]
    w = W.infer(map(W.page, ["s e", *(f"s {x} e" for x in labels), " ".join(["s", *labels, "e"])]))
    assert W.accepts(w, " ".join(["s", *labels, "e"])) and W.accepts(w, "s e") and not W.accepts(w, " ".join(["s", *labels * 40, "e"]))
    w = W.infer(map(W.page, ["s e", " ".join(["s", *labels, "e"])]))
    assert W.accepts(w, " ".join(["s", *labels[::3], "e"])) and not W.accepts(w, " ".join(["s", *labels[::-1], "e"]))


def test_operators(spark, rows):
    df = spark.createDataFrame([(1, "<b>x</b>", "h"), (1, "<b>x</b>", "h"), (2, None, "h"), (3, "", None), (None, "# t", "g")], "id long, text string, kind string")
    assert rows(M.found_kinds(df, "id", "text", "kind")) == sorted([(1, "html"), (None, "markdown")], key=repr)
    assert rows(M.found_kinds(df, "id", "text", "kind", ("markdown",))) == [(1, "html")]
    assert M.cleaned(df, "id", "text").count() == 5
    got = {(r.host, r.template): (r.n_pages, r.n_streams) for r in M.host_wrappers(df, "kind", "text").collect()}
    assert got == {("h", ""): (3, 2), (None, ""): (1, 1), ("g", "markdown"): (1, 1)}
    for f in (lambda x: M.found_kinds(x, "id", "text", "kind"), lambda x: M.cleaned(x, "id", "text"), lambda x: M.host_wrappers(x, "kind", "text")):
        assert f(df.limit(0)).count() == 0


def test_wrappers_of_both_tables(spark, tmp_path):
    spark.createDataFrame([(1, "<b>x</b>", "h")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [(1, "r", "old", 1), (1, "r", "# new", 2), (2, "r", "# x\n\n**y**", 1), (3, "h", None, 1), (4, None, "z", 1)]
    spark.createDataFrame(pairs, "pair_id long, repo string, target_content string, loaded_at int").write.parquet(f"{tmp_path}/structure_pair.parquet")
    got = {(r.tab, r.host, r.template): (r.n_pages, r.n_streams) for r in Q.p2_wrappers(spark, str(tmp_path)).collect()}
    assert got == {("documents", "h", ""): (1, 1), ("structure_pair", "r", "markdown"): (2, 1), ("structure_pair", "h", ""): (1, 1), ("structure_pair", None, ""): (1, 1)}


@pytest.mark.parametrize("text, kinds", KINDS)
def test_the_parse_and_the_slots_hold_every_kind(text, kinds):
    labels, inside = M.page_stream(text)
    bits = M.parsed_kinds(W.page(" ".join(labels)), labels)
    assert bits is not None and len(labels) == len(inside)
    for x in inside:
        bits |= x
    assert [k for k in M.KINDS if bits & M._BIT[k]] == kinds


def test_wrappers_are_the_same_however_rows_are_spread(spark, rows):
    rnd = random.Random(3)
    marks = ["<h1>a</h1>", "<p>b</p>", "<ul>\n<li>c</li>\n</ul>", "# d\n", "> e\n", "plain <b>f</b>"]
    data = [(i, "\n\n".join(rnd.choice(marks) for _ in range(rnd.randint(0, 6))), f"h{i % 2}") for i in range(200)]
    df = spark.createDataFrame(data, "id long, text string, kind string")
    one = rows(M.host_wrappers(df.coalesce(1), "kind", "text"))
    assert one == rows(M.host_wrappers(df.orderBy(F.desc("id")).repartition(7), "kind", "text"))
    want = sorted((i, k) for i, t, _ in data for k in M.kinds(t))
    assert rows(M.found_kinds(df, "id", "text", "kind")) == sorted(want, key=repr)


def test_nesting_to_any_depth_and_unclosed_marks():
    assert M.clean("\\textbf{\\emph{" * 40 + "x" + "}}" * 40 + " y") == "x y"
    for t in ("<pre>" * 20000, "<pre " * 20000, "\\begin{verbatim}" * 10000, "\\textbf{" * 20000, "<pre>x</style>" * 10000):
        M.kinds(t)
        M.clean(t)
