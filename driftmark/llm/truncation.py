"""Texts cut off on their way (problem 1), found by how often what they end in ends anything else.

Each text is reduced to units: sentences, list entries, table rows, headings, code blocks. Word trigrams inside units and
at their ends, with and without an end mark, are counted over all texts; the last trigram of each text is joined with the
counts. An ending that is frequent inside units but almost never terminal is a cut; so is one that almost never is terminal
without an end mark, unless the text's source lacks its mark, too: the source only vetoes. Where a trigram is too rare to tell, its
last two words, its last word and its kind of unit are looked up, whose counts are sums of those of trigrams. A last word that no
text holds is a broken one, and the trigram before it decides. Only units that another unit follows count as ends, so cut
texts don't pass for evidence. Everything is SQL expressions over whole texts, run in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.runtime import checkpointed, latest_by

#: What may follow the place of a cut: blanks, broken characters, dots, or a note in brackets. Neither pattern repeats a group, so none recurses.
_BLANKS = r"[\s\u00a0\u3000\ufffd…]"
_NOTES = r"\.{3,}|[\[(（【](?:…|cut|cut off|truncated|snip|more|continued)[\])）】]"

_FENCED = r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?^[ \t]*\1[`~]*[ \t]*$"
_OPEN = r"(?ms)^[ \t]*(?:`{3,}|~{3,}).*\z"
#: End of a sentence: an end mark that isn't that of an abbreviation, a number or a name, then a blank or the next ideograph.
_BREAK = r"(?<![ (][\p{L}]\.)(?<=[.!?][\"')»]{0,2})[ \t]+(?=[^\p{Ll}\s])|(?<=[。！？])(?=[^”’」』）。！？])"
_END = r"[.!?。！？][\"')»”’」』）]*$"
#: A point that may be an abbreviation's.
_SHORT = r"(?:(?<![\p{L}\p{M}\p{N}_.-])\p{L}{1,4}|(?<![\p{L}\p{M}\p{N}_-])\p{L}\.\p{L})\.$"
_TOKEN = (
    r"«[a-z]»|\p{IsHan}|[\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{M}][\p{L}\p{M}'’]*+(?:[-_.][\p{L}\p{N}]++)*+|\p{N}++|[`|\[<&]|-{2,}"
)
#: Constructions that stand for one word, whatever is in them.
_MASKS = (
    (r"`[^`\n]+`", "«c»"),
    (r"!?\[[^\[\]\n]*\]\([^()\s]*\)", "«l»"),
    (r"(?i)(?<![\p{L}\p{N}_])v\d+\.\d+\.\d+(?!\p{N})", "«v»"),
    (r"(?<![\p{L}_])\p{N}[\p{N}.,]*(?=\P{N}|$)", "«n»"),
)


@dataclass(frozen=True)
class Rules:
    """most_terminal: the share of an ending's occurrences that may be terminal, or terminal without end mark, if it is a cut.

    least: occurrences from which an ending tells anything, for three words, two words and one word. least_marked:
    occurrences inside units, none terminal, that outweigh an end mark (an abbreviation that a text stops after). least_before:
    occurrences of a word from which one that never follows it elsewhere, though it is known, counts as a broken word (a first letter).
    """

    most_terminal: float = 0.05
    least: tuple[int, int, int] = (12, 16, 40)
    least_marked: int = 20
    least_before: int = 400


#: What an ending is judged by, the most telling first: the last three, two and one words in units of its kind, and the kind; ``..2``: the
#: words before a last word that no text holds.
LEVELS = ("trigram", "trigram2", "pair", "pair2", "word", "word2", "kind")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _body(text: Column) -> Column:
    """The text without what follows a cut, code blocks as one line each (an open one as «o»), line ends as \\n."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), _NOTES, "…")
    plain = F.regexp_replace(plain, rf"(?<!{_BLANKS}){_BLANKS}++\z", "")
    return F.regexp_replace(F.regexp_replace(plain, _FENCED, "«f»"), _OPEN, "«o»")


def _units_sql(lines: str) -> str:
    """Array of struct(kind, text, marked) in order, of an array of lines; kind: f code, t table row, l list entry, h heading, p prose.

    marked: closed as its kind is: a fence, a bar, an end mark.
    """
    marks = r"^(?:[-*+•–]|\d+[.)])(?:\s|$)"
    kind = f"CASE WHEN l IN ('«f»', '«o»') THEN 'f' WHEN l LIKE '|%' THEN 't' WHEN l RLIKE {_quoted(marks)} THEN 'l' WHEN l RLIKE '^#' THEN 'h' ELSE 'p' END"
    lead = r"^(?:[-*+•–]|\d+[.)]|#{1,6}|>)(?:\s+|$)"
    marked = f"CASE WHEN l LIKE '|%' THEN s LIKE '%|' WHEN l IN ('«f»', '«o»') THEN l = '«f»' ELSE s RLIKE {_quoted(_END)} END"
    text = f"regexp_replace(l, {_quoted(lead)}, '')"
    return (
        f"flatten(transform(filter(transform({lines}, x -> trim(x)), x -> x != ''), l -> "
        f"transform(filter(split({text}, {_quoted(_BREAK)}), s -> s != ''), s -> named_struct('kind', {kind}, 'text', s, 'marked', {marked}))))"
    )


def _words_sql(unit: str) -> str:
    """Hashes of the words of a unit after two marks of its kind, so that a short unit has a trigram, too."""
    out = f"CASE WHEN {unit}.kind = 'f' THEN '«f»' ELSE {unit}.text END"
    for pattern, word in _MASKS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, '{word}')"
    kind = f"xxhash64(concat('^', {unit}.kind))"
    return f"concat(array({kind}, {kind}), transform(regexp_extract_all({out}, {_quoted(_TOKEN)}, 0), t -> xxhash64(t)))"


def _keys_sql(i: str) -> str:
    """The keys of the ending with the i-th word of w: three, two and one words in a unit of its kind, the word anywhere, the kind."""
    return (f"named_struct('t', xxhash64(w[0], w[{i}-3], w[{i}-2], w[{i}-1]), 'p', xxhash64(w[0], w[{i}-2], w[{i}-1]), 'u', xxhash64(w[0], w[{i}-1]), "
            f"'v', w[{i}-1], 'k', w[0])")


def ending_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``ending`` (key), ``inside``, ``terminal`` and ``bare`` (terminal without end mark) over all units of rows with ``lang`` and ``units``.

    ``units``: array of struct(w, marked), w from ``_words_sql``. The last unit of a text counts inside only, as its end isn't known to be
    one. A position leaves as one row; trigrams combine before the shuffle, and pairs, words and kinds are summed from their counts.
    """
    units = texts.select("lang", F.posexplode("units").alias("n", "u"), F.size("units").alias("of")).select(
        "lang", F.col("u.w").alias("w"), F.col("u.marked").alias("marked"), (F.col("n") == F.col("of") - 1).alias("last")).where("size(w) > 3 OR size(w) = 3 AND NOT last")
    grams = units.select("lang", "marked", F.expr("size(w)").alias("n"), F.posexplode(F.expr(
        f"transform(sequence(3, size(w) - CAST(last AS INT)), i -> {_keys_sql('i')})")).alias("i", "g"))
    end = F.col("i") + 3 == F.col("n")
    grams = grams.select("lang", "g.*", (~end).cast("long").alias("inside"), end.cast("long").alias("terminal"), (end & ~F.col("marked")).cast("long").alias("bare"))
    sums = [F.sum(c).alias(c) for c in ("inside", "terminal", "bare")]

    trigrams = grams.groupBy("lang", "t").agg(*[F.first(c).alias(c) for c in "puvk"], *sums)
    keys = ", ".join(f"xxhash64('{c}', {c})" for c in "tpuvk")
    return trigrams.select("lang", F.explode(F.expr(f"array({keys})")).alias("ending"), "inside", "terminal", "bare").groupBy("lang", "ending").agg(*sums)


def truncated(df: DataFrame, *, id_col: str = "apply_id", text_col: str = "target_new_content", source_text_col: str = "source_new_content",
              lang_col: str = "target_lang", provider_col: str = "provider", version_col: str = "loaded_at", rules: Rules = Rules()) -> DataFrame:
    """A row per record: ``id_col``, ``provider``, ``cut`` (boolean), ``reason`` and the ``level`` that decided it.

    Of redelivered records the latest version holds. Null, empty and blank texts aren't cut. reason: ``ending``, the ending
    almost never is one; ``bare``, it almost never is one without end mark (closing bar, closing fence) and the source doesn't lack that, too;
    ``broken_word``, the last word is in no text, or nowhere after the frequent word before it. Where these don't flag a text, one exact check follows: ``open_row``, a table row of
    fewer cells than the one before. Null languages are one language; a null source vetoes nothing. Texts are read whole,
    however long, with patterns that neither recurse nor rescan. An empty table gives no row.
    """
    text, src = F.col(f"`{text_col}`"), _body(F.col(f"`{source_text_col}`"))
    tail = F.expr("try_element_at(filter(split(__src, '\\n'), x -> trim(x) != ''), -1)")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{version_col}`").alias("version"), text.alias("text"),
                     F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.col(f"`{provider_col}`").alias("provider"), src.alias("__src"))
    # Of the source only the kind of its last unit and its mark are needed: 4 bytes instead of a text are shuffled.
    rows = rows.withColumn("__tail", tail).withColumn("__last", F.expr(f"try_element_at({_units_sql('array(__tail)')}, -1)")).select(
        "id", "version", "text", "lang", "provider", F.when(~F.col("__last.marked"), F.col("__last.kind")).alias("src_lacks"))
    rows = latest_by(rows, ["id"], "version", ["text", "lang", "provider", "src_lacks"])
    shaped = rows.withColumn("body", _body(F.col("text"))).withColumn("units", F.expr(_units_sql("split(body, '\\n')")))
    cells, cells_before = (F.length(F.regexp_replace(F.expr(f"try_element_at(units, {k})").getField("text"), r"[^|]", "")) for k in (-1, -2))
    # Both the counts and the endings need the words of all texts, which are dear to make: made once, 8 bytes a word.
    shaped = checkpointed(shaped.select(
        "id", "provider", "lang", "src_lacks", F.expr("try_element_at(units, -1).kind").alias("kind"),
        (F.expr("try_element_at(units, -1).marked AND try_element_at(units, -1).text RLIKE " + _quoted(_SHORT))).alias("short"),
        (F.expr("try_element_at(units, -1).kind = 't' AND try_element_at(units, -2).kind = 't'") & (cells < cells_before)).alias("open_row"),
        F.expr(f"transform(units, u -> named_struct('w', {_words_sql('u')}, 'marked', u.marked))").alias("units")))
    finals = shaped.withColumn("w", F.expr("try_element_at(units, -1).w")).withColumn("marked", F.expr("try_element_at(units, -1).marked")).where("size(w) >= 3")
    finals = finals.select("id", "provider", "lang", "src_lacks", "kind", "short", "open_row", "marked", F.expr(_keys_sql("size(w)")).alias("g"),
                           F.expr(f"CASE WHEN size(w) > 3 THEN {_keys_sql('(size(w)-1)')} END").alias("g2"))
    finals = finals.withColumn("final", F.xxhash64("g", "g2"))
    # Equal endings are looked up once, so a frequent one is no hot key of the join with the counts.
    levels = ((0, "t", "g.t"), (1, "t", "g2.t"), (2, "p", "g.p"), (3, "p", "g2.p"), (4, "u", "g.u"), (5, "u", "g2.u"), (6, "k", "g.k"), (7, "v", "g.v"))
    each = ", ".join(f"named_struct('level', {n}, 'ending', CASE WHEN {c} IS NOT NULL THEN xxhash64('{k}', {c}) END)" for n, k, c in levels)
    asked = finals.groupBy("lang", "final").agg(F.first("g").alias("g"), F.first("g2").alias("g2")).select("lang", "final", F.explode(F.expr(f"array({each})")).alias("a")).select(
        "lang", "final", "a.level", "a.ending").where("ending IS NOT NULL")
    counts = ending_counts(shaped.select("lang", "units"))
    least = "element_at(array({0}, {0}, {1}, {1}, {2}, {2}, 1), level + 1)".format(*rules.least)
    enough = F.expr(f"level < 7 AND inside + terminal >= {least}")
    found = asked.join(counts, ["lang", "ending"]).groupBy("lang", "final").agg(
        F.min(F.when(enough & F.col("level").isin(0, 2, 4, 6), F.struct("level", "inside", "terminal", "bare"))).alias("seen_best"),
        F.min(F.when(enough, F.struct("level", "inside", "terminal", "bare"))).alias("broken_best"), F.bool_or(F.col("level") == 7).alias("seen"),
        F.bool_or(F.col("level") == 2).alias("follows"), F.max(F.when(F.col("level") == 5, F.col("inside"))).alias("before"))
    apart = (F.coalesce("before", F.lit(0)) >= rules.least_before) & ~F.coalesce("follows", F.lit(False))
    seen = F.coalesce("seen", F.lit(False)) & ~apart
    best = F.when(seen, F.col("seen_best")).otherwise(F.col("broken_best"))
    judged = finals.join(found, ["lang", "final"], "left").withColumn("b", best)
    n = F.col("b.inside") + F.col("b.terminal")
    rare, rare_bare = (F.col(c) / n <= rules.most_terminal for c in ("b.terminal", "b.bare"))
    veto = F.coalesce(F.col("src_lacks") == F.col("kind"), F.lit(False))
    reason = (
        F.when(F.col("marked"), F.when(F.col("short") & (F.col("b.inside") >= rules.least_marked) & (F.col("b.terminal") == 0), "ending"))
        .when(rare, "ending").when(rare_bare & ~veto, "bare").when(~seen, "broken_word"))
    reason = F.coalesce(reason, F.when(F.col("open_row"), "open_row"))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("b.level") + 1)
    out = judged.select("id", "provider", reason.alias("reason"), F.when(reason.isin("ending", "bare"), level).alias("level"))
    rest = shaped.where("coalesce(size(try_element_at(units, -1).w), 0) < 3").select("id", "provider", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("level"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "provider", F.col("reason").isNotNull().alias("cut"), "reason", "level")


def truncation_rates(cuts: DataFrame) -> DataFrame:
    """``provider`` (null is one), ``n_records``, ``n_cut`` and ``share`` of its records that are cut."""
    return cuts.groupBy("provider").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("cut").alias("n_cut")).withColumn(
        "share", F.col("n_cut") / F.col("n_records"))
