"""Cutting oversized texts at natural boundaries, in balanced pieces with an overlap (problem 4).

The least number of pieces is computed, equal-length targets are placed, each is snapped to the
strongest boundary near it, and if any limit fails the same is tried with one piece more. Texts
within the limit never leave the JVM.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.runtime import ship

SECTION, BLOCK, LINE, CODE_LINE, SENTENCE, WORD, ANY = 6, 5, 4, 3, 2, 1, 0

_FENCE = re.compile(r"[ +\-]?[ \t]*(`{3,}|~{3,})")
_HEADING = re.compile(r"[ +]?#{1,6}[ \t]")
_SENTENCE_END = re.compile(r"[.!?][\"')\]]*[ \t]+(?=[^a-z\s])|[。！？][”’」』）]*")
_BLANK = re.compile(r"[^\S\n]+")


@dataclass(frozen=True)
class Limits:
    """max_chars: of a piece, overlap included. overlap: shared by consecutive pieces. Both in code points."""

    max_chars: int = 3000
    overlap: int = 200

    def __post_init__(self):
        if not 0 <= self.overlap < self.max_chars / 2:
            raise ValueError("the overlap must be less than half of a piece")


def boundaries(text: str) -> dict[int, int]:
    """Offset of each place where the text may be cut, with its strength.

    SECTION: before a heading or a hunk. BLOCK: after a blank line, before or after a fenced block.
    LINE: any other line start. CODE_LINE: a line start inside a fenced block. Then sentence ends and blanks.
    """
    found: dict[int, int] = {}
    at, fence, blank = 0, "", False
    for line in text.split("\n"):
        size = len(line) + 1
        mark = _FENCE.match(line)
        if fence:
            found[at] = CODE_LINE
            if mark and mark[1].startswith(fence):
                fence = ""
                found[at + size] = BLOCK
        else:
            strength = BLOCK if blank or mark else LINE
            if line.startswith("@@") or _HEADING.match(line):
                strength = SECTION
            found[at] = max(strength, found.get(at, 0))
            if mark:
                fence = mark[1]
            else:
                for m in _SENTENCE_END.finditer(line):
                    found.setdefault(at + m.end(), SENTENCE)
        for m in _BLANK.finditer(line):
            found.setdefault(at + m.end(), WORD)
        blank = not line.strip(" +-\t\r")
        at += size
    return {k: v for k, v in found.items() if 0 < k < len(text)}


def overlap_start(text: str, cut: int, floor: int, overlap: int) -> int:
    """Where the piece after ``cut`` begins: whole lines of at most ``overlap`` characters, else, or if those are blank, just so many characters."""
    low = max(floor, cut - overlap)
    if overlap == 0 or low >= cut:
        return cut
    if low == 0 or text[low - 1] == "\n":
        return low
    line = text.find("\n", low, cut - 1)
    return line + 1 if line >= 0 and text[line + 1:cut].strip() else low


def _snap(places: list[int], strength: dict[int, int], target: float, low: float, high: float) -> tuple[int, int] | None:
    """The strongest boundary from low to high; of equally strong ones that nearest the target, then the first."""
    i, j = bisect.bisect_left(places, low), bisect.bisect_right(places, high)
    if i >= j:
        return None
    best = min(places[i:j], key=lambda p: (-strength[p], abs(p - target), p))
    return best, strength[best]


def _place(text: str, n: int, places: list[int], strength: dict[int, int], limits: Limits) -> list[tuple[int, int, int, int]] | None:
    """Spans of ``n`` pieces, or None if one breaks a limit."""
    length = len(text)
    step = length / n
    spans, start, cut = [], 0, 0
    for k in range(1, n + 1):
        if k == n:
            end, kind = length, SECTION
        else:
            # Near the target, within this piece's limit, and leaving no more than the pieces to come can hold.
            low = max(k * step - 0.45 * step, cut + 1, length - (n - k) * (limits.max_chars - limits.overlap))
            high = min(k * step + 0.45 * step, start + limits.max_chars)
            end, kind = _snap(places, strength, k * step, low, high) or (round(min(max(k * step, low), high)), ANY)
            while kind == ANY and cut + 1 < end and "\u0300" <= text[end] <= "\u036f":
                end -= 1
        if not cut < end <= start + limits.max_chars:
            return None
        spans.append((start, cut, end, kind))
        start, cut = overlap_start(text, end, cut, limits.overlap), end
    return spans


def split_spans(text: str, limits: Limits = Limits()) -> list[tuple[int, int, int, int]]:
    """(start, cut, end, strength) of each piece, which is text[start:end] and new from ``cut`` on.

    ``strength`` tells the kind of boundary at the piece's end. A text within the limit is one piece;
    an empty one has none. Without any boundary in reach the cut falls on the target itself, moved off
    combining marks. Where the least number of pieces has to cut within lines and one piece more doesn't, or
    less badly, it is one more.
    """
    length = len(text)
    if length == 0:
        return []
    if length <= limits.max_chars:
        return [(0, 0, length, SECTION)]
    strength = boundaries(text)
    places = sorted(strength)
    n = -(-(length - limits.overlap) // (limits.max_chars - limits.overlap))
    while (spans := _place(text, n, places, strength, limits)) is None:
        n += 1
    weakest = min(s[3] for s in spans[:-1])
    if weakest < LINE:
        more = _place(text, n + 1, places, strength, limits)
        if more and min(s[3] for s in more[:-1]) > weakest:
            return more
    return spans


def _long(df: DataFrame, id_col: str, text_col: str, extra: str, limits: Limits) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("rec_id"), F.col(f"`{extra}`").alias("version"), F.col(f"`{text_col}`").alias("text"))


def piece_counts(df: DataFrame, id_col: str, text_col: str, version_col: str, limits: Limits = Limits()) -> DataFrame:
    """``rec_id`` and ``n_pieces`` of the latest version of each record: 0 for null and empty texts.

    Only ids, versions and counts are shuffled, never texts. Redelivered records count once; of equal
    versions the one with more pieces holds. Null ids form one record.
    """
    rows = _long(df, id_col, text_col, version_col, limits)
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= limits.max_chars).select(
        "rec_id", "version", (F.coalesce(F.length("text"), F.lit(0)) > 0).cast("int").alias("n_pieces"))
    ship(df.sparkSession)
    schema = f"rec_id {df.schema[id_col].dataType.simpleString()}, version {df.schema[version_col].dataType.simpleString()}, n_pieces int"

    def count(batches):
        import pyarrow as pa

        for b in batches:
            n = [len(split_spans(t, limits)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32())], ["rec_id", "version", "n_pieces"])

    long = rows.where(F.length("text") > limits.max_chars).mapInArrow(count, schema)
    return short.unionByName(long).groupBy("rec_id").agg(F.max(F.struct("version", "n_pieces")).alias("r")).select("rec_id", F.col("r.n_pieces").alias("n_pieces"))


def split_texts(df: DataFrame, id_col: str, text_col: str, version_col: str, limits: Limits = Limits()) -> DataFrame:
    """A row per piece: ``rec_id``, ``piece_no`` (from 0), ``n_pieces``, ``start``, ``end``, ``overlap``, ``boundary``, ``piece``.

    ``start`` and ``end`` are offsets in code points; the pieces without their overlaps, put together,
    are the text. A text within the limit is one piece, null and empty texts are none. Redelivered
    records come out once, in their latest version. Extra columns aren't read.
    """
    rows = _long(df, id_col, text_col, version_col, limits)
    rows = rows.groupBy("rec_id").agg(F.max(F.struct("version", "text")).alias("r")).select("rec_id", F.col("r.text").alias("text")).where("length(text) > 0")
    short = rows.where(F.length("text") <= limits.max_chars).select(
        "rec_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.length("text").alias("end"),
        F.lit(0).alias("overlap"), F.lit(SECTION).alias("boundary"), F.col("text").alias("piece"))
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"rec_id {kind}, piece_no int, n_pieces int, start int, end int, overlap int, boundary int, piece string"

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    spans = split_spans(t, limits)
                    out += [(i, k, len(spans), s, e, c - s, kind_, t[s:e]) for k, (s, c, e, kind_) in enumerate(spans)]
                names = ["rec_id", "piece_no", "n_pieces", "start", "end", "overlap", "boundary", "piece"]
                types = [part.column(0).type, *[pa.int32()] * 6, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], types[j]) for j in range(8)], names)

    return short.unionByName(rows.where(F.length("text") > limits.max_chars).mapInArrow(cut, schema))
