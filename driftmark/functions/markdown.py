"""Column functions on titles, paths, links and credentials. IDs: SC1 SC2 SC4 SC6 SC8 SC11 SC13 SC15-SC18 STR11-STR14 FLT2 FLT5-FLT10 FLT13 FLT15 JS1 JS2 SRC4 SRC5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a heading holds besides its words: the mark of its level, spans, back-ticks, an anchor at the end.
TITLE_MARKS = r"^\s*#{1,6}\s*|<span[^>]*>.*?</span>|`|\s*\{#[^}]+\}\s*$"


def clean_title(title: Column) -> Column:
    """A heading's words for comparison, without marks and outer blanks. Null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), TITLE_MARKS, ""), r"^\s+|\s+$", "")


def anchor_slug(title: Column) -> Column:
    """The anchor of a heading: its runs of ASCII letters and digits in lower case, joined by hyphens.

    The marks of code, links and anchors part no words, tags do; a point between digits joins them.
    """
    shown = F.regexp_replace(F.regexp_replace(title, r"\s*\{#[^}]+\}\s*$|\]\([^)]+\)|`", ""), r"</?[^>]+>", " ")
    joined = F.regexp_replace(shown, r"(?<=\d)\.(?=\d)", "")
    return F.array_join(F.regexp_extract_all(F.lower(joined), F.lit("[a-z0-9]+"), F.lit(0)), "-")


def path_key(path: Column) -> Column:
    """A path as one name without collisions."""
    return F.replace(F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit("--"), F.lit("%2D%2D")), F.lit("/"), F.lit("--"))


#: Where a secret begins: after the scheme of an authorization, or after a name that says so and an equals sign or colon.
_SECRET_NAME = r"(?:[a-z0-9]+[_-])*(?:api[_-]?key|access[_-]?key|token|secret|password|passwd)"
SECRET_AFTER = rf"""(?i)(\bauthorization["']?\s*[:=]\s*["']?(?:[a-z]+\s+)?|\b{_SECRET_NAME}["']?\s*[:=]\s*["']?)[^\s"'&,;@\[]+"""
#: The password of the user that an address names.
SECRET_USER = r"(://[^/\s:@]*:)[^/\s@]+@"
HIDDEN = "[REDACTED]"


def redact(text: Column, known: tuple[str, ...] = ()) -> Column:
    """The text with credentials hidden: passwords in addresses, authorizations, values of names of secrets, and the ``known`` values wherever they stand."""
    for value in sorted((v for v in known if v), key=len, reverse=True):
        text = F.replace(text, F.lit(value), F.lit(HIDDEN))
    return F.regexp_replace(F.regexp_replace(text, SECRET_USER, f"$1{HIDDEN}@"), SECRET_AFTER, f"$1{HIDDEN}")


def processing_type(path: Column) -> Column:
    """How a file is handled: toc, image, markdown, or other."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(name.startswith("TOC"), "toc").when(F.lower(path).rlike(r"\.(png|jpe?g|gif|svg|webp|bmp|ico)$"), "image").when(F.lower(path).endswith(".md"), "markdown").otherwise("other"))


def links(text: Column) -> Column:
    """Targets of the inline links of a text that point to Markdown files, without anchor and leading slash; distinct, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\]\n]*\]\(([^)\s#]+\.md)(?:#[^)\s]*)?\)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^(?:\.\.?/)*/*", "")))


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def set_heading_level(text: Column, level: Column) -> Column:
    """The text with the level of its first line's heading set, kept between 1 and 6."""
    n = F.least(F.greatest(level, F.lit(1)), F.lit(6))
    return F.when(text.rlike(r"^#{1,10}\s+\S"), F.concat(F.repeat(F.lit("#"), n), F.lit(" "), F.regexp_replace(text, r"^#{1,10}\s+", ""))).otherwise(text)


def repo_of_url(url: Column) -> Column:
    """``owner/name``, pull request number and commit range of a pull request address, as a struct; null parts where it is none."""
    p = r"^https?://[^/]+/([^/]+/[^/]+)/pull/(\d+)(?:/(?:files|changes)/([0-9a-f]{7,40})\.\.([0-9a-f]{7,40}))?/?$"

    def part(k: int) -> Column:
        return F.nullif(F.regexp_extract(url, p, k), F.lit(""))

    return F.struct(part(1).alias("repo"), part(2).cast("int").alias("number"), part(3).alias("base"), part(4).alias("head"))


def name_status(line: Column) -> Column:
    """A row of a name-status listing as struct(status, filename, previous_filename); other letters count as modified."""
    parts = F.split(line, "\t")
    code = F.substring(F.element_at(parts, 1), 1, 1)
    status = F.when(code == "A", "added").when(code == "D", "removed").when(code == "R", "renamed").otherwise("modified")
    return F.struct(status.alias("status"), F.element_at(parts, -1).alias("filename"), F.when(code == "R", F.get(parts, 1)).alias("previous_filename"))


SVG = r"(?s)<svg\b.*?</svg>"


def strip_blocks(text: Column, pattern: str = SVG, name: str = "SVG") -> Column:
    """struct(text, blocks): each distinct match replaced by a numbered placeholder, and the matches in the order of their numbers."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    numbered = F.transform(found, lambda x, i: F.struct(x.alias("b"), F.concat(F.lit(f"{{{{{name}_"), (i + 1).cast("string"), F.lit("}}")).alias("p")))
    return F.struct(F.aggregate(numbered, text, lambda t, x: F.replace(t, x["b"], x["p"])).alias("text"), found.alias("blocks"))


def restore_blocks(text: Column, blocks: Column, name: str = "SVG") -> Column:
    """The inverse of ``strip_blocks``; later numbers first, so that 1 isn't taken for the beginning of 10."""
    numbered = F.reverse(F.transform(blocks, lambda x, i: F.struct(x.alias("b"), F.concat(F.lit(f"{{{{{name}_"), (i + 1).cast("string"), F.lit("}}")).alias("p"))))
    return F.aggregate(numbered, text, lambda t, x: F.replace(t, x["p"], x["b"]))


def localized_links(text: Column, host: str, locale: str) -> Column:
    """Absolute links to a host with the locale as first step of their path; links that have one keep theirs."""
    return F.regexp_replace(text, rf"(https?://\Q{host}\E)(?!/(?:zh|ja|en|de|es)(?:/|\b))(?=/|\b)", f"$1/{locale}")


def absolute_links(text: Column, root: str) -> Column:
    """Relative links to Markdown files as absolute ones below a root, by base name without extension; anchors stay."""
    return F.regexp_replace(text, r"\]\((?!https?://)(?:[^()\s#]*/)?([^()\s#/]+)\.md(#[^()\s]*)?\)", f"]({root.rstrip('/')}/$1$2)")


def localized_aliases(line: Column, prefix: str) -> Column:
    """An ``aliases:`` line with the prefix before each path of its list; other lines, and paths that have it, stay."""
    items = F.transform(F.regexp_extract_all(line, F.lit(r"[\"']?(/[^\"',\]\s]*)[\"']?"), F.lit(1)), lambda x: F.when(x.startswith(prefix + "/"), x).otherwise(F.concat(F.lit(prefix), x)))
    return F.when(line.rlike(r"^aliases:\s*\[.*\]\s*$"), F.concat(F.lit("aliases: ['"), F.array_join(items, "','"), F.lit("']"))).otherwise(line)


def json_object(reply: Column) -> Column:
    """The first to the last brace of a reply as a map of strings; null where that isn't an object."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), "map<string,string>")


def fenced_list(reply: Column) -> Column:
    """The non-blank lines of a reply's fenced block, or of the reply if it has none, without list marks."""
    inner = F.regexp_extract(reply, r"(?s)```[^\n]*\n(.*?)```", 1)
    body = F.when(inner != "", inner).otherwise(reply)
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^(?:[-*+]|\d+[.)])\s+", ""))
    return F.filter(lines, lambda x: x != "")


def keep_indentation(text: Column, model: Column) -> Column:
    """The lines of a text with the indentation of the lines at the same places of a model."""
    pairs = F.zip_with(F.split(text, "\n", -1), F.split(model, "\n", -1), lambda a, b: F.when(a.isNull(), None).when(b.isNull(), a).otherwise(
        F.concat(F.regexp_extract(b, r"^([ \t]*)", 1), F.regexp_replace(a, r"^[ \t]+", ""))))
    return F.array_join(pairs, "\n")


#: A fenced block to its end, or to the end of the text if it is left open.
FENCED = r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*$.*?(?:^[ \t]*\1[`~]*[ \t]*$|\z)"


def blank_before_headings(text: Column) -> Column:
    """The text with a blank line before every heading that has none; what is in fenced blocks stays."""
    held = strip_blocks(text, FENCED, "\ue000CODE")
    spaced = F.regexp_replace(held["text"], r"(?m)^(?=[^\n]*\S)([^\n]*)\n(?=#{1,6} \S)", "$1\n\n")
    return restore_blocks(spaced, held["blocks"], "\ue000CODE")


def is_headingless(text: Column) -> Column:
    """Whether a page has no heading outside its front matter and fenced blocks, as landing pages do; null for null."""
    body = F.regexp_replace(text, r"(?ms)\A(.*?)^[ \t]*---[ \t]*$.*?(?:^[ \t]*---[ \t]*$|\z)", "$1")
    body = F.regexp_replace(body, r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\z)", "")
    return ~body.rlike(r"(?m)^[ \t]*#")


def is_wrapper_line(line: Column) -> Column:
    """Whether a line is the opening or closing mark of a component and nothing else; one that closes itself isn't."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return bare.rlike(r"^</?[A-Z][A-Za-z0-9]*(?:\s[^<>]*)?>$") & ~bare.endswith("/>")


TAGS_ONLY = r"^\s*(?:</?CustomContent\b[^<>]*>\s*)+$"


def is_verbatim(block: Column) -> Column:
    """Whether a block has nothing to translate: no words, a fenced block, or custom tags alone."""
    return ~block.rlike(r"[\p{L}]") | block.rlike(r"^\s*(?:`{3,}|~{3,})") | block.rlike(TAGS_ONLY)


def protect_tags(text: Column, pattern: str = r"</?[A-Za-z][^<>]*>") -> Column:
    """struct(text, tags, nonce): every tag as a placeholder with its number and a nonce of the text's own, so that no two texts share placeholders."""
    nonce = F.substring(F.sha2(text, 256), 1, 8)
    tags = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    marked = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\u27e6"), nonce, F.lit(":"), i.cast("string"), F.lit("\u27e7"), x)))
    return F.struct(F.array_join(marked, "").alias("text"), tags.alias("tags"), nonce.alias("nonce"))


def restore_tags(text: Column, tags: Column, nonce: Column) -> Column:
    """The text with its tags back, or null where the placeholders aren't all there, once each and in order: the sequence is checked, not guessed."""
    pattern = F.concat(F.lit("\u27e6"), nonce, F.lit(":(\\d+)\u27e7"))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: x.cast("int"))
    wanted = F.when(F.size(tags) > 0, F.sequence(F.lit(1), F.size(tags))).otherwise(F.array().cast("array<int>"))
    parts = F.split(text, F.concat(F.lit("\u27e6"), nonce, F.lit(":\\d+\u27e7")), -1)
    whole = F.array_join(F.zip_with(parts, F.concat(F.array(F.lit("")), tags), lambda x, t: F.concat(t, x)), "")
    return F.when(found == wanted, whole)


def unwrapped_fence(reply: Column) -> Column:
    """A reply without the one fence that wraps all of it; a reply that only begins or ends with a block of its own stays."""
    inner = F.regexp_extract(reply, r"(?s)\A\s*```(?:markdown|md)?[ \t]*\n(.*)\n```\s*\z", 1)
    # A bare mark that comes first within would close the outer one.
    within = F.regexp_extract_all(inner, F.lit(r"(?m)^[ \t]*```[ \t]*([^\n]*?)[ \t]*$"), F.lit(1))
    return F.when((inner != "") & (F.size(within) % 2 == 0) & ((F.size(within) == 0) | (F.get(within, 0) != "")), inner).otherwise(reply)


def section_key(title: Column) -> Column:
    """A heading's key without versions and spans, for matching across releases."""
    return F.lower(F.regexp_replace(clean_title(title), r"\bv?\d+(?:\.\d+)+\b", "*"))


def is_identifier_title(title: Column) -> Column:
    """Whether a cleaned title is a single word of letters, digits and joining marks with at least one of them, as settings are named."""
    return title.rlike(r"^[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)+$")
