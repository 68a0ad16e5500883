"""Markup residue: which markup a text holds, and clean text that keeps its structure (problem 2).

A text is lexed into a stream of structural marks (headings, lists, tables, blocks) and text slots between them. The streams of a
host's pages are clustered by template, the languages of markup they are built of, and aligned into a wrapper a template, a
union-free regular expression (``wrappers``). A page's kinds are those of the wrapper's marks that it is parsed by, and those of
the inline marks, the residue, that stand in its text slots. Clean text is made from the same tokens: headings, lists,
code blocks, tables and formulas stay distinguishable.
"""

from __future__ import annotations

import html as _html
import re
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm import wrappers as wrapper_rules
from driftmark.runtime import checkpointed, ship

KINDS = ("html", "markdown", "wiki", "latex")

# Element names of HTML, except those that are also common names of a value.
_TAGS = """a abbr address area article aside audio b base basefont bdi bdo big blink blockquote body br button
canvas caption center cite code col colgroup dd del details dfn dialog dir div dl dt em embed fieldset figcaption
figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd
legend li link main map mark marquee menu meta meter nav nobr noframes noscript ol optgroup option p picture pre
progress q rp rt ruby s samp script section select small span strike strong style sub summary sup svg table tbody
td template textarea tfoot th thead title tr tt u ul var video wbr""".split()
_WIKI_TAGS = "nowiki ref references math syntaxhighlight gallery includeonly noinclude onlyinclude".split()

# Commands of LaTeX that stand without braces.
_COMMANDS = """le leq ge geq ne neq alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi
pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega sum prod int
infty partial nabla cdot cdots ldots dots times pm mp approx equiv sim in notin subset supset cup cap forall exists
to rightarrow leftarrow Rightarrow Leftarrow mapsto log ln exp sin cos tan min max lim sup inf quad qquad newpage
clearpage pagebreak linebreak newline noindent indent par item hline toprule midrule bottomrule centering maketitle
tableofcontents bf it em tt rm sf sc sl bfseries itshape ttfamily small large Large footnotesize tiny huge medskip
bigskip smallskip vfill hfill appendix LaTeX TeX left right displaystyle limits""".split()

_FENCED = re.compile(r"^(?P<q>[ \t]*(?:>[ \t]?)*)(?P<f>`{3,}|~{3,})(?P<info>[^\n`]*)\n(?P<body>.*?)(?:^(?P=q)[ \t]*(?P=f)[`~]*[ \t]*\r?$|\Z)", re.M | re.S)
_PRE = re.compile(r"<(?P<n>pre|syntaxhighlight|script|style)\b[^<>]*>|</(?P<e>pre|syntaxhighlight|script|style)\s*>", re.I)
_VERBATIM = re.compile(r"\\begin\{(?P<n>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\])?|\\end\{(?P<e>verbatim\*?|lstlisting|minted)\}")
_INDENTED = re.compile(r"(?:(?<=\n\n)|(?<=\n\r\n)|\A)(?P<body>(?:[ \t](?!\s*(?:[-*+]|\d+[.)])\s)[^\n]*(?:\n|\Z))+)")
_INLINE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)(?<!`)\1(?!`)")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)

_HTML = re.compile(
    r"</?(?:" + "|".join(sorted(_TAGS, key=len, reverse=True)) + r")(?:\s[^<>\n]*)?/?>"
    r"|<(?:" + "|".join(sorted(_TAGS, key=len, reverse=True)) + r")\s+[a-z-]+\s*=|<!doctype\b|<!--|-->"
    r"|&(?:\#\d{1,7}|\#x[0-9a-f]{1,6});", re.I)
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]{1,30});")
_LATEX = re.compile(
    r"(?<![\w:\\.])\\(?:begin|end)\s*\{[^}\n]*\}"
    r"|(?<![:\\.])(?<![A-Za-z]:)\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{"
    r"|(?<![\w:\\.])\\(?P<c>[A-Za-z]+)(?![A-Za-z_\\])"
    r"|^%+[ \t]*[A-Za-z][^\n]*$|\\[()\[\]]|(?<=\d)[ \t]?\\%|\\[%&#](?=\s)", re.M)
_DOLLARS = re.compile(r"\$\$(?!\$).+?\$\$", re.S)
_DOLLAR = re.compile(r"(?<![\\$\w])\$(?![\s$])(?P<b>[^$\n]*?[^\s$\\])\$(?![\d$\w])")
_MATH = re.compile(r"[\\_^{}=<>+]|^[A-Za-z]$|^[A-Za-z]\s*[-*/]\s*[A-Za-z0-9]$")
_WIKI_PAGE = re.compile(r"^={2,6}[ \t]*[^=\s][^\n]*?={2,6}[ \t]*\r?$|\[\[(?:Category|Kategorie|Categoría|Категория|分类):|^\{\|", re.M | re.I)
_WIKI = re.compile(
    r"^={2,6}[ \t]*[^=\s][^\n]*?={2,6}[ \t]*\r?$|\[\[[^\[\]\n]+\]\]|(?<!')'{2,3}(?!')[^'\s][^\n]*?(?<!')'{2,3}(?!')|'{5}[^'\n]+'{5}"
    r"|\{\{[^\s{}][^{}\n]*\}\}|^\{\||^\|\}|^\|-[ \t\-]*\r?$|\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*)?\](?!\()|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|^\#REDIRECT\b"
    r"|</?(?:" + "|".join(_WIKI_TAGS) + r")\b[^<>\n]*>", re.M)
_MD_HEADING = re.compile(r"^ {0,3}\#{1,6}[ \t]+\S", re.M)
_MD = re.compile(
    r"^[ \t]{0,3}(?:>[ \t]?)+(?=\S)|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\r?$|^\|[ \t]*:?-+:?[ \t]*\|[ \t]*\r?$"
    r"|!?\[[^\[\]\n]*\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)|(?<!\w)!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]|(?<=[^\s\[\]\d])\[[^\[\]\n]{2,}\]\[[^\[\]\n]*\]|\[\^[^\]\s]+\]|^[ \t]{0,3}\[[^\]\n]+\]:[ \t]*\S+"
    r"|\*\*\*?(?=[^\s*])[^\n*]*[^\s*]\*\*\*?|(?<![A-Za-z0-9_])__(?=[^\s_])[^\n]*?[^\s_]__(?![A-Za-z0-9_])|~~(?=[^\s~])[^\n~]*[^\s~]~~"
    r"|(?<![A-Za-z0-9*\\])\*(?=[^\s*])[^\n*]*[^\s*\\]\*(?![A-Za-z0-9*])|(?<![\w\\])_(?=[^\s_])[^\n_]*[^\s_\\]_(?!\w)"
    r"|^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]|<(?:https?|mailto):[^<>\s]+>", re.M)
_SETEXT = re.compile(r"(?:\A|(?<=\n\n)|(?<=\n\r\n))[^\s|<>\[#=\-*+][^\n]*\n(?:={3,}|-{3,})[ \t]*\r?(?=\n|\Z)")
_FRONT = re.compile(r"\A\ufeff?---[ \t]*\r?\n(?:[A-Za-z_][\w-]*:[^\n]*\n|[ \t-][^\n]*\n)+---[ \t]*\r?(?=\n|\Z)")


def _enclosed(pattern: re.Pattern, text: str) -> list[tuple[str, int, int, int, int]]:
    """(name, start, start of the body, its end, end) of each opening mark with the next closing one of its name; each mark is looked at once."""
    marks = [((m["n"] or m["e"]).lower(), m["n"] is not None, m.start(), m.end()) for m in pattern.finditer(text)]
    close: list[int | None] = [None] * len(marks)
    following: dict[str, int] = {}
    for k in range(len(marks) - 1, -1, -1):
        name, opens = marks[k][:2]
        if opens:
            close[k] = following.get(name)
        else:
            following[name] = k
    out, k = [], 0
    while k < len(marks):
        at = close[k]
        if at is None:
            k += 1
        else:
            out.append((marks[k][0], marks[k][2], marks[k][3], marks[at][2], marks[at][3]))
            k = at + 1
    return out


def _replaced(spans, text: str, new) -> str:
    out, at = [], 0
    for name, s, body, body_end, e in spans:
        out += [text[at:s], new(text[body:body_end])]
        at = e
    return "".join([*out, text[at:]]) if out else text


def _mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans blanked out, line structure and offsets kept."""
    if not spans:
        return text
    out, at = [], 0
    for s, e in sorted(spans):
        if e <= at:
            continue
        s = max(s, at)
        out.append(text[at:s])
        out.append(re.sub(r"[^\n]", "\x00", text[s:e]))
        at = e
    out.append(text[at:])
    return "".join(out)


Token = tuple[str, str, int, int]


def tokens(text: str) -> list[Token]:
    """The markup tokens (kind, label, start, end) of a text in order; what stands inside code isn't markup."""
    if not text or not _ANY.search(text):
        return []
    out: list[Token] = []
    hidden: list[tuple[int, int]] = []
    m = _FRONT.match(text)
    if m:
        out.append(("markdown", "front", m.start(), m.end()))
        hidden.append(m.span())
    for m in _FENCED.finditer(text):
        out.append(("markdown", "fence", m.start(), m.end()))
        hidden.append(m.span())
    rest = _mask(text, hidden)
    spans = []
    if "<" in rest:
        for name, start, _, _, end in _enclosed(_PRE, rest):
            out.append(("wiki" if name == "syntaxhighlight" else "html", name, start, end))
            spans.append((start, end))
    if "\\begin" in rest:
        for _, start, _, _, end in _enclosed(_VERBATIM, rest):
            out.append(("latex", "verbatim", start, end))
            spans.append((start, end))
    if spans:
        rest = _mask(rest, spans)
        spans = []
    wiki_page = bool(_WIKI_PAGE.search(rest))
    for m in _INDENTED.finditer(rest):
        spans.append(m.span())
        if wiki_page and "\x00" not in m[0]:
            out.append(("wiki", "preformatted", m.start(), m.end()))
    for m in _INLINE.finditer(_mask(rest, spans)):
        out.append(("markdown", "code", m.start(), m.end()))
        spans.append(m.span())
    rest = _mask(rest, spans)
    formulas = []
    if "$" in rest:
        for m in _DOLLARS.finditer(rest):
            out.append(("latex", "formula", m.start(), m.end()))
            formulas.append(m.span())
        for m in _DOLLAR.finditer(_mask(rest, formulas)):
            if _MATH.search(m["b"]):
                out.append(("latex", "formula", m.start(), m.end()))
                formulas.append(m.span())
        rest = _mask(rest, formulas)
    if "<" in rest or "&" in rest or "-->" in rest:
        for m in _HTML.finditer(rest):
            name = re.match(r"</?([a-z0-9]+)", m[0], re.I)
            out.append(("html", name[1].lower() if name else m[0][:2], m.start(), m.end()))
        for m in _ENTITY.finditer(rest):
            if m[1] + ";" in html5:
                out.append(("html", "entity", m.start(), m.end()))
        rest = _mask(rest, [m.span() for m in _COMMENT.finditer(rest)])
    if "\\" in rest or "\n%" in rest or rest[:1] == "%":
        for m in _LATEX.finditer(rest):
            if m["c"] is None or m["c"] in _COMMAND_SET:
                label = re.match(r"\\(?:(?:begin|end)\s*\{[^}\n]*|[A-Za-z]+|.)", m[0].strip())
                out.append(("latex", label[0].strip("\\{ ") if label else "escape", m.start(), m.end()))
    wiki = [(("wiki", m[0][:2] if m[0][:1] in "=[{'|" else "wiki", m.start(), m.end())) for m in _WIKI.finditer(rest)]
    out += wiki
    rest = _mask(rest, [(s, e) for _, _, s, e in wiki])
    for m in _MD.finditer(rest):
        out.append(("markdown", _md_label(m[0]), m.start(), m.end()))
    for m in _SETEXT.finditer(rest):
        if "\x00" not in m[0]:
            out.append(("markdown", "heading", m.start(), m.end()))
    if not wiki_page:
        for m in _MD_HEADING.finditer(rest):
            out.append(("markdown", "heading", m.start(), m.end()))
    out.sort(key=lambda t: (t[2], -t[3]))
    return out


_COMMAND_SET = frozenset(_COMMANDS)
_ANY = re.compile(r"[<>&\\$\[\]{}`*_#~'|%]|={2}|-{3}")


def _md_label(mark: str) -> str:
    s = mark.lstrip()
    if s.startswith("!["):
        return "image"
    if s.startswith("[^"):
        return "footnote"
    if s.startswith("["):
        return "link"
    if s.startswith(">"):
        return "quote"
    if s[:1] in "*_~":
        return "emphasis"
    return "table" if "-" in s and "[" not in s else "other"


def kinds(text: str | None) -> list[str]:
    """The kinds of markup that a text holds, in the order of KINDS. None, empty and plain texts hold none."""
    held = {t[0] for t in tokens(text)} if text else set()
    return [k for k in KINDS if k in held]


_OPEN, _CLOSE = "\ufdd0", "\ufdd1"  # never characters of a text


def clean(text: str | None) -> str | None:
    """Clean text: headings as ``#`` lines, list entries as ``- `` or ``1. ``, code in ``` fences, formulas in
    dollars, table rows as cells between ``|``; all other markup gone, entities resolved. Null stays null."""
    if text is None:
        return None
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"{_OPEN}{len(kept) - 1}{_CLOSE}"

    def block(body: str, info: str = "") -> str:
        return "\n" + keep(f"```{info.strip()}\n" + body.strip("\r\n") + "\n```") + "\n"

    t = text.replace("\r\n", "\n").lstrip("\ufeff").replace(_OPEN, "").replace(_CLOSE, "")
    t = _FRONT.sub("", t)
    t = _FENCED.sub(lambda m: block(m["body"], m["info"]), t)
    t = re.sub(r"<(script|style|title)\b[^>]*>.*?</\1\s*>", "", t, flags=re.I | re.S)
    t = _replaced(_enclosed(_PRE, t), t, lambda body: block(_html.unescape(re.sub(r"</?code\b[^<>]*>", "", body, flags=re.I))))
    t = _replaced(_enclosed(_VERBATIM, t), t, block)
    wiki_page = bool(_WIKI_PAGE.search(t))
    if wiki_page:
        t = _INDENTED.sub(lambda m: block(re.sub(r"^ ", "", m["body"], flags=re.M)), t)
    t = _INLINE.sub(lambda m: keep(m[2]), t)
    t = _DOLLARS.sub(lambda m: keep(m[0]), t)
    t = _DOLLAR.sub(lambda m: keep(m[0]) if _MATH.search(m["b"]) else m[0], t)
    t = re.sub(r"\\\((.+?)\\\)", lambda m: keep(f"${m[1].strip()}$"), t)
    t = re.sub(r"\\\[(.+?)\\\]", lambda m: keep(f"$${m[1].strip()}$$"), t, flags=re.S)
    t = re.sub(r"\\begin\{(equation|align|gather|displaymath)(\*?)\}(.+?)\\end\{\1\2\}", lambda m: keep(f"$${m[3].strip()}$$"), t, flags=re.S)
    t = _COMMENT.sub("", t)
    if "\\" in t:
        t = _clean_latex(t)
    if "<" in t or "&" in t:
        t = _clean_html(t)
    if wiki_page or _WIKI.search(t):
        t = _clean_wiki(t, wiki_page)
    t = _clean_markdown(t)
    t = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", t)).strip()
    # Code within code: what was kept may hold what was kept before it, to any depth.
    for k, x in enumerate(kept):
        kept[k] = _PLACE.sub(lambda m: kept[int(m[1])], x)
    return _PLACE.sub(lambda m: kept[int(m[1])], t)


_PLACE = re.compile(f"{_OPEN}(\\d+){_CLOSE}")


def _unwrapped(t: str) -> str:
    """The text without commands around braces and switches within them, however deep they nest; one pass with a stack."""
    cut: list[tuple[int, int]] = []
    stack: list[tuple[int, int] | None] = []
    for m in _BRACES.finditer(t):
        mark = m[0]
        if mark == "}":
            held = stack.pop() if stack else None
            if held:
                cut += [held, m.span()]
        elif mark not in ("\\{", "\\}"):
            stack.append(m.span() if len(mark) > 1 else None)
    out, at = [], 0
    for s, e in sorted(cut):
        out.append(t[at:s])
        at = e
    return "".join([*out, t[at:]])


_BRACES = re.compile(r"(?<![\w:\\])\\[A-Za-z]+\*?\{|\{\\[A-Za-z]+[ \t]+|\\[{}]|[{}]")


def _clean_latex(t: str) -> str:
    depth = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
    t = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * depth[m[1]] + " " + m[2] + "\n", t)
    t = re.sub(r"^%+[ \t]*[A-Za-z][^\n]*$\n?", "", t, flags=re.M)
    t = re.sub(r"[ ~]?\\(?:label|cite[pt]?|ref|eqref|pageref|index|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    t = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
    t = re.sub(r"\\begin\{tabular\}(?:\{[^}]*\})?(.*?)\\end\{tabular\}", lambda m: "\n".join(
        "| " + " | ".join(c.strip() for c in row.split("&")) + " |" for row in re.split(r"\\\\", re.sub(r"\\hline|\\(?:top|mid|bottom)rule", "", m[1])) if row.strip()), t, flags=re.S)
    numbered = re.compile(r"\\begin\{enumerate\}(.*?)\\end\{enumerate\}", re.S)
    t = numbered.sub(lambda m: re.sub(r"^\s*\\item\s*", "1. ", m[1].strip("\n"), flags=re.M), t)
    t = re.sub(r"^[ \t]*\\item(?:\[[^\]]*\])?\s*", "- ", t, flags=re.M)
    t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", "", t)
    t = _unwrapped(t)
    t = re.sub(r"(?<![\w:\\.])\\(" + "|".join(sorted(_COMMANDS, key=len, reverse=True)) + r")(?![A-Za-z_\\])[ \t]?", "", t)
    return re.sub(r"\\([%&#_${}])", r"\1", t)


def _clean_html(t: str) -> str:
    t = re.sub(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", lambda m: "\n" + "#" * int(m[1]) + " " + m[2].strip() + "\n", t, flags=re.I | re.S)
    t = re.sub(r"<ol\b[^>]*>(.*?)</ol\s*>", lambda m: "\n" + re.sub(r"<li\b[^>]*>", "\n1. ", m[1], flags=re.I) + "\n", t, flags=re.I | re.S)
    t = re.sub(r"\n*<li\b[^>]*>", "\n- ", t, flags=re.I)
    t = re.sub(r"<tr\b[^>]*>(.*?)</tr\s*>", lambda m: "\n| " + " | ".join(c.strip() for c in re.findall(r"<t[dh]\b[^>]*>(.*?)</t[dh]\s*>", m[1], re.I | re.S)) + " |", t, flags=re.I | re.S)
    t = re.sub(r"</?(?:p|div|br|table|ul|ol|body|html|head|tr|hr|blockquote|section)\b[^<>\n]*>", "\n", t, flags=re.I)
    t = re.sub(r"<(?:" + "|".join(_TAGS) + r")\s+(?:[a-z-]+\s*=\s*(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s<>\"'.]*)\s*)+/?>?", "", t, flags=re.I)
    t = _HTML.sub(lambda m: m[0] if m[0].startswith("&") else "", t)
    return _html.unescape(t)


def _clean_wiki(t: str, page: bool) -> str:
    t = re.sub(r"^(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", lambda m: "#" * (len(m[1]) - 1) + "\x01" + m[2], t, flags=re.M)
    t = re.sub(r"[ \t]?\[\[(?:File|Image|Category|Datei|Archivo|Файл|文件)\s*:[^\]]*\]\]", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", t)
    t = re.sub(r"[ \t]?\{\{[^{}]*\}\}", "", t)
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]([^\]\n]*))?\](?!\()", lambda m: m[1] or "", t)

    def rows(m: re.Match) -> str:
        out = []
        for row in re.split(r"^\|-.*$", m[1], flags=re.M):
            cells = [c.strip() for line in row.split("\n") if line[:1] in "|!" for c in re.split(r"\|\||!!", line[1:])]
            if cells:
                out.append("| " + " | ".join(cells) + " |")
        return "\n".join(out)

    t = re.sub(r"^\{\|[^\n]*\n(.*?)^\|\}", rows, t, flags=re.M | re.S)
    if page:
        t = re.sub(r"^#(?!#*\x01)[ \t]*", "1. ", t, flags=re.M)
        t = re.sub(r"^\*+[ \t]*(?=\S)", "- ", t, flags=re.M)
    t = t.replace("\x01", " ")
    t = re.sub(r"(?<!')('{2,3}|'{5})(?!')([^'\n]+?)\1(?!')", r"\2", t)
    return re.sub(r"</?(?:" + "|".join(_WIKI_TAGS) + r")\b[^<>\n]*>", "", t)


def _clean_markdown(t: str) -> str:
    t = re.sub(r"^([^\s|<>\[#\-*+][^\n]*)\n={3,}[ \t]*$", r"# \1", t, flags=re.M)
    t = re.sub(r"^([^\s|<>\[#\-*+][^\n]*)\n-{3,}[ \t]*$", r"## \1", t, flags=re.M)
    t = re.sub(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", r"\1 \2", t, flags=re.M)
    t = re.sub(r"!\[([^\[\]\n]*)\](?:\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])", r"\1", t)
    t = re.sub(r"\[([^\[\]\n]+)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", t)
    t = re.sub(r"\[([^\[\]\n\d][^\[\]\n]*)\]\[[^\[\]\n]*\]", r"\1", t)
    t = re.sub(r"^[ \t]{0,3}\[\^?[^\]\n]+\]:[^\n]*$", "", t, flags=re.M)
    t = re.sub(r"\[\^[^\]\s]+\]", "", t)
    t = re.sub(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|[ \t]*$\n?", "", t, flags=re.M)
    t = re.sub(r"^[ \t]{0,3}(?:>[ \t]?)+", "", t, flags=re.M)
    t = re.sub(r"(\*{2,3})(?=[^\s*])([^\n*]*[^\s*])\1", r"\2", t)
    t = re.sub(r"(?<![A-Za-z0-9_])__(?=[^\s_])([^\n]*?[^\s_])__(?![A-Za-z0-9_])", r"\1", t)
    t = re.sub(r"~~(?=[^\s~])([^\n~]*[^\s~])~~", r"\1", t)
    t = re.sub(r"(?<![A-Za-z0-9*])\*(?=[^\s*])([^\n*]*[^\s*])\*(?![A-Za-z0-9*])", r"\1", t)
    t = re.sub(r"^([ \t]*)[*+•‣–][ \t]+", r"\1- ", t, flags=re.M)
    return re.sub(r"^([ \t]*\d+)\)[ \t]+", r"\1. ", t, flags=re.M)


# Labels of structural marks; all other marks stand within text.
_STRUCTURE = {
    "html": frozenset("""h1 h2 h3 h4 h5 h6 p div ul ol li dl dt dd table thead tbody tfoot tr td th caption pre br hr blockquote section article header
footer nav aside main figure figcaption form fieldset body html head title details summary script style iframe center address <!""".split()),
    "markdown": frozenset("front fence heading table quote".split()),
    "wiki": frozenset("== {| |} |- syntaxhighlight preformatted".split()),
    "latex": frozenset("begin end verbatim part chapter section subsection subsubsection paragraph item documentclass usepackage title maketitle tableofcontents newpage hline".split()),
}
_BIT = {k: 1 << i for i, k in enumerate(KINDS)}


def page_stream(text: str | None) -> tuple[list[str], list[int]]:
    """The page as labels, one per structural mark and # for each stretch of text between them, and per label the kinds of the inline marks in it, as bits."""
    labels: list[str] = []
    inside: list[int] = []
    if not text:
        return labels, inside
    at, pending = 0, 0

    def slot(end: int) -> None:
        nonlocal pending
        if pending or end > at and text[at:end].strip():
            labels.append("#")
            inside.append(pending)
            pending = 0

    for kind, label, s, e in tokens(text):
        if label.split("{")[0] not in _STRUCTURE[kind]:
            pending |= _BIT[kind]
            continue
        if e > at:
            slot(s)
            labels.append(f"{kind}:{label.replace(' ', '_')}")
            inside.append(0)
            at = e
        else:  # within the mark before
            pending |= _BIT[kind]
    slot(len(text))
    return labels, inside


def template_of(labels: list[str]) -> str:
    """The cluster of a page: the languages of markup that its structure is written in."""
    held = {x.partition(":")[0] for x in labels}
    return "+".join(k for k in KINDS if k in held)


def parsed_kinds(wrapper: tuple, labels: list[str]) -> int | None:
    """The kinds, as bits, of the wrapper's marks that the page is parsed by; None if the wrapper doesn't accept it."""
    if not wrapper_rules.accepts(wrapper, labels):
        return None
    out = 0
    for x in labels:
        out |= _BIT.get(x.partition(":")[0], 0)
    return out


def _columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("rec_id"), F.col(f"`{text_col}`").alias("text"))


def _sliced(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield b.slice(at, 256)


#: A host's streams are aligned in so many parts, then the parts: the result depends on the streams alone, not on how they are spread.
PARTS = 16


def _streams(df: DataFrame, id_col: str | None, host_col: str, text_col: str) -> DataFrame:
    """``rec_id``, ``host``, ``template``, ``stream`` and ``inside`` (the kinds of the marks in its slots, as bits) of each row."""
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString() if id_col else "int"

    def lex(batches):
        import pyarrow as pa

        for b in _sliced(batches):
            pages = [page_stream(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([template_of(x) for x, _ in pages], pa.string()), pa.array([" ".join(x) for x, _ in pages], pa.string()),
                pa.array([reduce(or_, m, 0) for _, m in pages], pa.int32())], ["rec_id", "host", "template", "stream", "inside"])

    rows = df.select((F.col(f"`{id_col}`") if id_col else F.lit(0)).alias("rec_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lex, f"rec_id {id_type}, host string, template string, stream string, inside int")


def _wrappers(streams: DataFrame) -> DataFrame:
    """``host``, ``template``, ``n_pages``, ``n_streams``, ``wrapper`` (JSON) of ``host, template, stream, n``, each stream once."""
    keys = ["host", "template", "part"]
    spread = streams.withColumn("part", F.pmod(F.xxhash64("stream"), F.lit(PARTS)).cast("int")).repartition(*keys).sortWithinPartitions(*keys, "stream")
    schema = "host string, template string, part int, n_pages bigint, n_streams bigint, wrapper string"

    def align(batches):
        import pyarrow as pa

        held: list = []
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

        def ended(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for b in batches:
            out = []
            for host, template, text, n, part in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[:3] != [host, template, part]:
                    out.append([*held[:5], wrapper_rules.dumps(held[5])])
                    held = []
                if not held:
                    held = [host, template, part, 0, 0, None]
                held[3:] = [held[3] + n, held[4] + 1, wrapper_rules.add(held[5], text)]
            yield ended(out)
        yield ended([[*held[:5], wrapper_rules.dumps(held[5])]] if held else [])

    def merge(key, pdf):
        import pandas as pd

        w = wrapper_rules.infer(map(wrapper_rules.loads, pdf.sort_values("part").wrapper))
        return pd.DataFrame({"host": [key[0]], "template": [key[1]], "n_pages": [pdf.n_pages.sum()], "n_streams": [pdf.n_streams.sum()], "wrapper": [wrapper_rules.dumps(w)]})

    parts = spread.select("host", "template", "stream", "n", "part").mapInArrow(align, schema)
    return parts.groupBy("host", "template").applyInPandas(merge, "host string, template string, n_pages bigint, n_streams bigint, wrapper string")


#: Pages of one stream, such as plain text, are spread over so many tasks when they are joined with what their stream is parsed to.
SALT = 16


def found_kinds(df: DataFrame, id_col: str, text_col: str, host_col: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """``rec_id`` and ``kind``, distinct: each kind of markup that the record's field holds, but those left out.

    The kinds of the marks that the wrapper of the page's host and template parses it by, and of the inline marks in the slots
    that it leaves. Each stream is parsed once. Null, empty and plain texts give no row, redelivered records one row a kind. Texts
    are read whole and never shuffled; streams of labels are, and are written once to the shared folder. Null ids are kept as one
    record, a null host is a host. A page that its wrapper didn't accept would be one slot; there is none, as all are inferred from.
    """
    pages = checkpointed(_streams(df.where(F.length(f"`{text_col}`") > 0), id_col, host_col, text_col).where("stream != ''"))
    streams = pages.groupBy("host", "template", "stream").agg(F.count(F.lit(1)).alias("n"))
    on = [F.col("s.host").eqNullSafe(F.col("w.host")), F.col("s.template") == F.col("w.template")]
    asked = streams.alias("s").join(_wrappers(streams).alias("w"), on).select("s.host", "s.template", "s.stream", "w.wrapper")

    def parse(batches):
        import pyarrow as pa

        held: dict[str, tuple] = {}
        for b in batches:
            texts, found = b.column(2).to_pylist(), []
            for text, w in zip(texts, b.column(3).to_pylist()):
                if w not in held:
                    held.clear()
                    held[w] = wrapper_rules.loads(w)
                labels = text.split()
                bits = parsed_kinds(held[w], labels)
                found.append(sum(_BIT[k] for k in template_of(labels).split("+") if k) if bits is None else bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.int32())], ["host", "template", "stream", "bits"])

    parsed = asked.mapInArrow(parse, "host string, template string, stream string, bits int").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALT)).cast("int"))
    on = [F.col("p.host").eqNullSafe(F.col("q.host")), *[F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("template", "stream", "salt")]]
    both = salted.alias("p").join(parsed.alias("q"), on)
    bits = F.col("q.bits").bitwiseOR(F.col("p.inside"))
    named = F.filter(F.array(*[F.when(bits.bitwiseAND(_BIT[k]) > 0, F.lit(k)) for k in KINDS if k not in leave_out]), lambda x: x.isNotNull())
    return both.select("p.rec_id", F.explode(named).alias("kind")).distinct()


def cleaned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rec_id``, ``kinds`` and ``clean``, the text without markup, a row per row of the input. Null texts have neither."""
    ship(df.sparkSession)

    def lex(batches):
        import pyarrow as pa

        for b in _sliced(batches):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if t is None else kinds(t) for t in texts], pa.list_(pa.string())), pa.array([clean(t) for t in texts], pa.string())],
                ["rec_id", "kinds", "clean"])

    return _columns(df, id_col, text_col).mapInArrow(lex, f"rec_id {df.schema[id_col].dataType.simpleString()}, kinds array<string>, clean string")


def host_wrappers(df: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """A row per host and template: ``host``, ``template``, ``n_pages``, ``n_streams`` (different streams) and its ``wrapper``.

    Streams are counted first, so pages of one stream meet once. Those of a host and template are aligned in ``PARTS`` parts, in
    order, each a task's fold that holds nothing but the wrapper, and then the parts: no host, however large, gathers in one
    task, and neither the number of tasks nor the order of rows changes the result. Null hosts form a host; pages without text have an
    empty stream.
    """
    streams = _streams(df, None, host_col, text_col).groupBy("host", "template", "stream").agg(F.count(F.lit(1)).alias("n"))
    show = F.udf(lambda w: wrapper_rules.show(wrapper_rules.loads(w)))
    return _wrappers(streams).select("host", "template", "n_pages", "n_streams", show("wrapper").alias("wrapper"))
