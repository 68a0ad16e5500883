"""One consistent form for texts that look the same (problem 8).

Look-alike classes are the transitive closure, by union-find, of relations between code points and
strings: characters without width and the empty string, kinds of blanks, full-width and joined forms
and what they stand for, composed letters and letter plus accent, letters of other scripts and blocks
with the same shape. The representative of a class is its most frequent member in the corpus. Texts
are rewritten greedily, leftmost longest match first, by a multi-pattern automaton.

Visible differences stay: case, accents, digits, raised and circled figures, dashes, styled
(bold, Fraktur) letters, joiners inside emoji and in scripts where they change the shape.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.runtime import checkpointed, ship

# Letters of the same shape, as Unicode's confusables name them.
SAME_SHAPE = """
A Α А Ꭺ ꓮ
B Β В Ᏼ ꓐ
C С Ϲ Ꮯ ꓚ
D Ꭰ ꓓ
E Ε Е Ꭼ ꓰ
F Ϝ ꓝ
G Ԍ Ꮐ ꓖ
H Η Н Ꮋ ꓧ
I Ι І Ӏ
J Ј Ꭻ ꓙ
K Κ К Ꮶ ꓗ
L Ꮮ ꓡ
M Μ М Ꮇ ꓟ
N Ν ꓠ
O Ο О Օ ꓳ
P Ρ Р Ꮲ ꓑ
Q Ԛ
R Ꭱ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Τ Т Ꭲ ꓔ
U Ս ꓴ
V Ѵ Ꮩ ꓦ
W Ԝ Ꮃ ꓪ
X Χ Х ꓫ
Y Υ Ү ꓬ
Z Ζ Ꮓ ꓜ
a а
c с ϲ ᴄ
d ԁ
e е
g ɡ
h һ
i і
j ј ϳ
l ӏ
o ο о օ ᴏ
p р
q ԛ
s ѕ ꜱ
u ս ᴜ
v ν ѵ ᴠ
w ԝ ᴡ
x х
y у
z ᴢ
Å Å
"""

#: Characters without width.
NO_WIDTH = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
_JOINERS = "‌‍"
_MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿゙゚]{2,}")
_ACCENT = re.compile("[̀-ͯ]")
_PAIR = re.compile("[^\\W\\d_][̀-ͯ]")
_ASCII = frozenset(map(chr, range(128)))


class Classes:
    """Union-find over strings, of one character or more."""

    def __init__(self) -> None:
        self._up: dict[str, str] = {}

    def find(self, x: str) -> str:
        up = self._up
        up.setdefault(x, x)
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            # An ASCII character, or else the lesser string, is the root: no class gets two ASCII ones.
            low, high = sorted((ra, rb), key=lambda s: (s not in _ASCII, s))
            if high in _ASCII:
                raise ValueError(f"{low!r} and {high!r} would look the same")
            self._up[high] = low

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self._up):
            out.setdefault(self.find(x), []).append(x)
        return out


def relations() -> list[tuple[str, str]]:
    """Pairs (character, string that looks the same), from the rules of the Unicode database and the table of shapes."""
    out = [(c, "") for c in NO_WIDTH] + [("\r\n", "\n"), ("‑", "‐")]
    for line in SAME_SHAPE.split("\n"):
        letters = line.split()
        if letters:
            out += [(x, letters[0]) for x in letters[1:] if x != letters[0]]
    for code in range(0xA0, min(sys.maxunicode, 0x2FFFF) + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:  # Hangul is composed by rule, below; surrogates
            continue
        c = chr(code)
        if unicodedata.category(c) == "Zs":
            out.append((c, " "))
            continue
        shape = unicodedata.decomposition(c)
        if not shape:
            continue
        tag, _, rest = shape.rpartition(">")
        to = "".join(chr(int(h, 16)) for h in rest.split())
        name = unicodedata.name(c, "")
        if (
            not tag
            or tag in ("<wide", "<narrow")
            or tag == "<compat" and (0x2E80 <= code <= 0x2FDF or 0xFB00 <= code <= 0xFB06 or name.startswith(("ROMAN NUMERAL", "SMALL ROMAN NUMERAL"))
                                     or name.startswith("LATIN") and any(w in name for w in ("LIGATURE IJ", "LETTER DZ", "LETTER LJ", "LETTER NJ")))
            or tag == "<font" and name.startswith(("MATHEMATICAL SANS-SERIF CAPITAL", "MATHEMATICAL SANS-SERIF SMALL", "MATHEMATICAL SANS-SERIF DIGIT", "MATHEMATICAL MONOSPACE"))
        ):
            out.append((c, to))
    return out


_held: dict = {}


def look_alike_classes() -> tuple[Classes, Classes]:
    """The classes of code points, and those of strings: each joined or composed character with the string that looks the same.

    Relations to one character or to nothing are unions of code points. A relation to a longer string is a union with the
    sequence of its characters' classes, so that it holds for every spelling of that string and all that stand for one
    string, be they joined forms, composed letters or doubles of such, are one class with it. Built once a process.
    """
    if "classes" not in _held:
        _held["classes"] = _build_classes()
    return _held["classes"]


def _build_classes() -> tuple[Classes, Classes]:
    points, strings, long = Classes(), Classes(), []
    for a, b in relations():
        if len(b) <= 1:
            points.union(a, b)
        else:
            long.append((a, b))
    # A class that holds a joined character is spelled out like it.
    spelled = {points.find(a): b for a, b in long}

    def roots(s: str) -> str:
        return "".join(roots(spelled[r]) if r in spelled else r for r in map(points.find, s))

    for root, members in points.members().items():
        if root in spelled:
            for m in members:
                strings.union(m, roots(root))
    for a, b in long:
        strings.union(a, roots(b))
    return points, strings


def _spelling(members: list[str]) -> str:
    """The member of a class of strings that spells the others out."""
    return max(members, key=lambda m: (len(m), m))


class Rewriter:
    """Rewrites texts to representatives. ``counts``: how often characters and letter-accent pairs occur."""

    def __init__(self, counts: dict[str, int]):
        points, strings = look_alike_classes()
        groups = list(strings.members().values())
        joined = {m: _spelling(ms) for ms in groups for m in ms if len(m) == 1}
        best = {}
        for root, members in points.members().items():
            single = [m for m in members if len(m) == 1 and m not in joined]
            # Forms of width and the like stand for another character and so never for a class.
            single = [m for m in single if not unicodedata.decomposition(m).startswith("<")] or single or [root]
            best[root] = "" if root == "" else max(single, key=lambda m: (counts.get(m, 0), m in _ASCII, -ord(m[0])))
        first = {}
        for root, members in points.members().items():
            first.update({m: best[root] for m in members if m and m != best[root]})
        first.update({c: "".join(best.get(x, x) for x in s) for c, s in joined.items()})
        # A composed letter represents its class where it is more frequent than letter plus accent; classes of one spelling now are one.
        second, rivals = {}, Classes()
        for members in groups:
            spelling = "".join(best.get(x, x) for x in _spelling(members))
            if len(spelling) == 2 and _PAIR.fullmatch(spelling):
                for m in members:
                    if len(m) == 1:
                        rivals.union(m, spelling)
        for members in rivals.members().values():
            spelling = _spelling(members)
            most = max((m for m in members if len(m) == 1), key=lambda m: (counts.get(m, 0), -ord(m)))
            if counts.get(most, 0) >= counts.get(spelling, 0):
                second[spelling] = most
        self.first, self.second = first, second
        self._one, self._two = (self._automaton(x) for x in (first, second))
        self._plain = not any(k in _ASCII for k in first)

    @staticmethod
    def _automaton(mapping: dict[str, str]):
        """Over the bytes of UTF-8, one character each: a state has few successors, so a step is cheap, and no match begins within a character."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, v in mapping.items():
            b = _as_bytes(k)
            a.add_word(b, (len(b), _as_bytes(v), k in _JOINERS))
        a.make_automaton()
        return a if mapping else None

    @staticmethod
    def _shaping(before: str) -> bool:
        """Whether a joiner after this character changes what is seen: emoji, Arabic and Indic scripts."""
        return before == "️" or "؀" <= before <= "ࣿ" or "ऀ" <= before <= "෿" or unicodedata.category(before) in ("So", "Sk")

    def _rewrite(self, text: str, automaton) -> str:
        """The text in bytes, one character each, with the matches replaced."""
        out, at = [], 0
        for end, (n, to, joiner) in automaton.iter_long(text):
            start = end - n + 1
            if joiner and start and self._shaping(_from_bytes(text[max(0, start - 4):start])[-1:]):
                continue
            out.append(text[at:start])
            out.append(to)
            at = end + 1
        if not out:
            return text
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if not text or self._plain and text.isascii() and "\r" not in text:
            return text
        b = _as_bytes(text)
        if "\xe1" in b and _JAMO.search(text):
            b = _as_bytes(unicodedata.normalize("NFC", text))
        b = self._rewrite(b, self._one)
        if any(x in b for x in _ACCENT_BYTES):
            b = _as_bytes(_MARKS.sub(lambda m: "".join(sorted(m[0], key=unicodedata.combining)), _from_bytes(b)))
            if self._two:
                b = self._rewrite(b, self._two)
        return _from_bytes(b)


def _as_bytes(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1")


def _from_bytes(text: str) -> str:
    """Its inverse; bytes of a character that was cut in front are left out."""
    return text.encode("latin-1").lstrip(_REST).decode("utf-8", "surrogatepass")


_REST = bytes(range(0x80, 0xC0))
#: What the UTF-8 of every character of _MARKS holds; most texts hold none of these.
_ACCENT_BYTES = ("\xcc", "\xcd", "\xd2", "\xe1", "\xe2\x83", "\xe3\x82\x99", "\xe3\x82\x9a")


def rewriter_of(counts: dict[str, int]) -> Rewriter:
    """The rewriter for these counts; the last one made is kept, as all tasks of a job use the same."""
    key = frozenset(counts.items())
    if _held.get("key") != key:
        _held["key"], _held["rewriter"] = key, Rewriter(counts)
    return _held["rewriter"]


_JAMO = re.compile("[ᄀ-ᇿ]")


def character_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``ch`` and ``n``: how often each character of a look-alike class, or letter plus accent, occurs in all texts.

    Counted per batch in Python and summed by one small shuffle: at most one row per relevant string
    leaves a batch. The result is bounded by the table of classes, some thousand rows, whatever the corpus.
    """
    ship(df.sparkSession)

    def count(batches):
        import pyarrow as pa

        members = [m for classes in look_alike_classes() for ms in classes.members().values() for m in ms]
        known = {m for m in members if len(m) == 1}
        letters = {m for m in members if len(m) == 2}
        total: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total.update(t)
                    if not t.isascii() and _ACCENT.search(t):
                        total.update(p for p in _PAIR.findall(t) if p in letters)
        kept = [(c, n) for c, n in total.items() if c in known or c in letters]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["ch", "n"])

    return df.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(count, "ch string, n bigint").groupBy("ch").agg(F.sum("n").alias("n"))


def consistent_forms(df: DataFrame, id_col: str, text_col: str, with_form: bool = True) -> DataFrame:
    """``id_col``, ``text_key``, ``form_key`` (128-bit hashes) and, if asked for, ``form``, the rewritten text.

    Null texts have null keys and form; an empty text keeps its own. Texts are rewritten whole. Repeated
    rows come out repeated. The only thing collected is the bounded table of character counts.
    """
    counts = {r.ch: r.n for r in character_counts(df, text_col).collect()}
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))

    def rewrite(batches):
        import pyarrow as pa

        to_form = rewriter_of(counts)

        def key(s: str) -> bytes:
            return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(1).to_pylist()
                forms = [None if t is None else to_form(t) for t in texts]
                a = [None if t is None else key(t) for t in texts]
                b = [None if t is None else k if f == t else key(f) for t, f, k in zip(texts, forms, a)]
                cols = [part.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary())]
                names = ["id", "text_key", "form_key"]
                if with_form:
                    cols.append(pa.array(forms, pa.string()))
                    names.append("form")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {kind}, text_key binary, form_key binary" + ", form string" * with_form
    return rows.mapInArrow(rewrite, schema).withColumnRenamed("id", id_col)


def _keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and the 128-bit keys of text (t1, t2) and form (f1, f2) of all rows with an id and something to be seen, repeated rows once.

    Rewriting is dear and keys are small, so they are written once. Keys are pairs of numbers, which aggregate by hash.
    """
    seen = df.where(F.col(f"`{text_col}`").rlike(r"[^\s\p{Z}\p{Cf}]") & F.col(f"`{id_col}`").isNotNull())
    forms = consistent_forms(seen, id_col, text_col, with_form=False)
    halves = [F.conv(F.substring(F.hex(c), at, 16), 16, -10).cast("bigint").alias(f"{c[0]}{n}") for c in ("text_key", "form_key") for n, at in ((1, 1), (2, 17))]
    return checkpointed(forms.select(F.col(id_col).alias("id"), *halves)).dropDuplicates()


def _mixed(keyed: DataFrame) -> DataFrame:
    """``f1``, ``f2`` of the forms that have more than one spelling; partial counts of copies meet, never copies."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("t1", "t2") for f in (F.min, F.max)]
    return keyed.groupBy("f1", "f2").agg(*ends).where("min_t1 != max_t1 OR min_t2 != max_t2").select("f1", "f2")


def look_alike_classes_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document of a class with different spellings: ``id_col``, ``class_id`` (least id), ``n_docs``, ``n_spellings``.

    Exact copies aren't expanded into pairs. Null, empty and blank texts belong to no class. Repeated rows count once.
    """
    keyed = _keys(df, id_col, text_col)
    per_text = keyed.groupBy("f1", "f2", "t1", "t2").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("c"))
    mixed = per_text.groupBy("f1", "f2").agg(F.min("m").alias("class_id"), F.sum("c").alias("n_docs"), F.count(F.lit(1)).alias("n_spellings")).where("n_spellings > 1")
    return keyed.join(mixed, ["f1", "f2"]).select(F.col("id").alias(id_col), "class_id", "n_docs", "n_spellings")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id_a``, ``doc_id_b``: documents that look the same but differ in characters, smaller id first.

    Only 16-byte keys are shuffled. Forms of one spelling, however many copies they have, drop out by an aggregate before any
    join. Pairs are made of spellings, of which a form has few, and then joined with the ids of either side: copies of one
    text never meet, and the work is in proportion to the result. ``look_alike_classes_of`` gives the same classes a row per
    document. Null ids make no pair. Rows with both the same id and different texts aren't a pair; repeated rows count once.
    """
    keyed = _keys(df, id_col, text_col)
    kept = keyed.join(_mixed(keyed), ["f1", "f2"], "left_semi")
    spellings = kept.select("f1", "f2", "t1", "t2").distinct()
    other = spellings.select("f1", "f2", F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    pairs = spellings.join(other, ["f1", "f2"]).where("t1 < u1 OR t1 = u1 AND t2 < u2").select("t1", "t2", "u1", "u2")
    ids = kept.select("t1", "t2", "id")
    left = pairs.join(ids.withColumnRenamed("id", "a"), ["t1", "t2"]).select("a", F.col("u1").alias("t1"), F.col("u2").alias("t2"))
    both = left.join(ids.withColumnRenamed("id", "b"), ["t1", "t2"]).where("a != b")
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()
