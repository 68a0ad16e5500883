"""Sentences of Markdown texts and of patches, with their places."""

from __future__ import annotations

import re

_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_LEAD = re.compile(r"[ \t]*(?:>[ \t]*)*(?:(?:[-*+•–]|\d{1,4}[.)])[ \t]+)?(?:>[ \t]*)*(?:\[[ xX]\][ \t]+)?")
_NONE = re.compile(r"[ \t]*(?:#{1,10}(?:[ \t]|$)|\||</?[A-Za-z][^<>]*>[ \t]*$|<!--.*-->[ \t]*$|={2,6}[^=]+={2,6}[ \t]*$|!\[[^\]]*\]\([^)]*\)[ \t]*$)")
#: An end mark with what may close after it; after a Latin one a blank or the line's end must follow. It begins with a set, which is searched for fast.
_END = re.compile(r"[.!?。！？](?:(?<=[.!?])[.!?]*[\"')»”’\]*_`]*(?=[ \t]|$)|(?<=[。！？])[。！？]*[”’」』）]*)")
# Abbreviations that don't end a sentence in the languages of the texts.
_ALWAYS = frozenset("e.g i.e z.b d.h u.a p.ej ej vs cf bzw ca ggf evtl vgl approx resp fig nr núm aprox".split())
_WORD_BEFORE = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*$")


def _ends(line: str, start: int, at: int) -> bool:
    """Whether the end mark from ``start`` to ``at`` ends a sentence."""
    if line[start] != "." or at - start > 1 and line[start + 1] == ".":
        return True
    while at < len(line) and line[at] in " \t":
        at += 1
    if at == len(line):
        return True
    if line[at].islower():
        return False
    last = line[start - 1:start]
    if not last.isalpha() or line[max(0, start - 7):start].isalpha() and start > 6:  # no word before it, or one too long for an abbreviation
        return True
    before = _WORD_BEFORE.search(line, max(0, start - 12), start)
    word = before[0].lower() if before else ""
    return not (word in _ALWAYS or len(word) == 1 and before.start() > 0 and line[before.start() - 1] in " (")


def of_line(line: str, offset: int, out: list[tuple[int, str]]) -> None:
    """Appends (place, sentence) of each sentence of a prose line, list entry or quoted line that begins at ``offset``."""
    at = 0 if line[:1].isalpha() else _LEAD.match(line).end()
    n = len(line)
    for m in _END.finditer(line, at):
        start, end = m.span()
        if end < n and not _ends(line, start, end):
            continue
        while at < n and line[at] in " \t　":
            at += 1
        if start > at:
            out.append((offset + at, line[at:end]))
        at = end


def of_markdown(text: str) -> list[tuple[int, str]]:
    """Sentences of a page. Headings, front matter, tables, code blocks, markup lines and what lacks an end mark hold none."""
    out: list[tuple[int, str]] = []
    offset, fence, front = 0, "", text.startswith(("---\n", "---\r\n"))
    for k, line in enumerate(text.split("\n")):
        size = len(line) + 1
        if line.endswith("\r"):
            line = line[:-1]
        if front:
            if k and line.rstrip() == "---":
                front = False
        elif fence:
            m = _FENCE.match(line)
            if m and m[1].startswith(fence) and not line[m.end():].strip():
                fence = ""
        elif line:
            first = line.lstrip(" \t")[:1]
            m = _FENCE.match(line) if first in "`~" else None
            if m:
                fence = m[1]
            elif first and not (first in "#|<=!" and _NONE.match(line)):
                of_line(line, offset, out)
        offset += size
    return out


def of_patch(patch: str) -> list[tuple[int, str]]:
    """Sentences of the added lines of a unified diff; places count from the patch's first character."""
    out: list[tuple[int, str]] = []
    offset, fence = 0, ""
    for line in patch.split("\n"):
        if line.startswith("@@"):
            fence = ""
        elif line.startswith("+") and not line.startswith("+++ "):
            body = line[1:-1] if line.endswith("\r") else line[1:]
            first = body.lstrip(" \t")[:1]
            m = _FENCE.match(body) if first in "`~" else None
            if fence:
                if m and m[1].startswith(fence) and not body[m.end():].strip():
                    fence = ""
            elif m:
                fence = m[1]
            elif first and not (first in "#|<=!" and _NONE.match(body)):
                of_line(body, offset + 1, out)
        offset += len(line) + 1
    return out


#: The alternatives begin with different characters; ASCII letters, the most frequent, come first. Code that a sentence's end cuts is no code name.
_TERM = re.compile(r"[A-Za-z]+[^\W\d_一-鿿]*|[一-鿿]+|\x00|`[^`\n\x00]+`|\d[\d.,]*\d|\d|[^\W\d_一-鿿]+")
#: Inline markup, which says nothing of the words: tags, formulas, templates, targets of links, references, entities.
_NOISE = re.compile(
    r"<!--.*?-->|</?[A-Za-z][^<>]*>|<img\s[^>。]*?(?:>|=(?=[.。!?！？])|$)|\$[^$\n]+\$|\\\([^\n]*?\\\)|\{\{[^{}]*\}\}|\[\[(?:File|Image|Category):[^\]]*\]\]|\[\^[^\]]*\]"
    r"|\\(?:footnote|cite|ref|label)\{[^{}]*\}|\\[A-Za-z]+\{?|&\#?\w+;|\]\([^()]*\)|\]\[[^\]]*\]|\[?https?://[^\s\]]+[ \t]?|'{2,}|\[\[|\]\]")
_SEPARATORS = str.maketrans("", "", ".,")


_MARKED = re.compile(r"[<\\$\[{&]|''")
#: Stands between sentences in one string of them all.
BETWEEN = "\x00"


def tokens(found: list[str]) -> list[str]:
    """Code names, numbers, words and runs of ideographs of sentences, without inline markup; BETWEEN ends each sentence."""
    joined = BETWEEN.join(found) + BETWEEN
    if joined.count(BETWEEN) != len(found):
        joined = BETWEEN.join(s.replace(BETWEEN, " ") for s in found) + BETWEEN
    if _MARKED.search(joined):
        joined = BETWEEN.join(_NOISE.sub("", s) if _MARKED.search(s) else s for s in joined[:-1].split(BETWEEN)) + BETWEEN
    return _TERM.findall(joined)


def terms_of(token: str) -> tuple[bool, list[str]]:
    """(is a name, terms): code names and numbers are names, which languages share; words are lower-cased, ideographs paired.

    Numbers lose their separators, which languages write differently.
    """
    c = token[0]
    if c == "`":
        return True, [token]
    if c.isdigit():
        return True, [token.translate(_SEPARATORS)]
    if "一" <= c <= "鿿":
        return False, [token[i:i + 2] for i in range(len(token) - 1)] or [token]
    return False, [token.lower()] if len(token) > 1 or not c.isascii() else []
