"""Text kernel: column functions for cleaning, tokens, similarity, delimiters, repairs and lists.

Blanks follow the ASCII class of the regular expressions, so the same text gives the same value in SQL.
"""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

LOST = "�"


def strip(text: Column) -> Column:
    """Blanks of every kind off both ends; NULL becomes ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of blanks to one space, none at the ends; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_latex(text: Column, lower: bool = True, unwrap: str = "textbf|emph|textit|mathrm|mathcal|mathbb") -> Column:
    """Plain text of a LaTeX source. Text macros are unwrapped before other commands go."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in (
        (r"\\(begin|end)\{[^}]*\}", ""),
        (r"\\label\{[^}]*\}", ""),
        (rf"\\({unwrap})\{{([^}}]*)\}}", "$2"),
        (r"\\item\b", ""),
        (r"\$", ""),
        (r"\\[a-zA-Z]+", " "),
        (r"[{}]", ""),
    ):
        out = F.regexp_replace(out, pattern, by)
    out = collapse(out)
    return F.lower(out) if lower else out


def analysis_words(text: Column, latex: bool = True) -> Column:
    """The pieces between blanks in small letters, for looking at what was lost; of LaTeX without commands and marks."""
    out = F.coalesce(text, F.lit(""))
    if latex:
        for pattern in (r"\\(begin|end)\{[^}]*\}", r"\\[a-zA-Z]+", r"[\$\{\}\\^_]"):
            out = F.regexp_replace(out, pattern, "")
    return F.filter(F.split(F.lower(out), r"\s+"), lambda w: w != "")


def normalize_ocr(text: Column) -> Column:
    """Without lost characters, blanks collapsed, small letters."""
    return F.lower(collapse(F.replace(F.coalesce(text, F.lit("")), F.lit(LOST), F.lit(""))))


def normalize_statement(text: Column) -> Column:
    """Small letters, blanks collapsed."""
    return F.lower(collapse(text))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in small letters, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def symbol_tokens(text: Column, lower: bool = True) -> Column:
    """Words (with underscores) and every other visible character on its own."""
    base = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(base) if lower else base, F.lit(r"[a-zA-Z0-9_]+|[^\s]"), 0)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Size of the common part over the union of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_recall(wanted: Column, got: Column) -> Column:
    """Share of the distinct ``wanted`` tokens in ``got``; 1 if none are wanted."""
    distinct = F.array_distinct(wanted)
    return F.when(F.size(distinct) == 0, 1.0).otherwise(F.size(F.array_intersect(distinct, got)) / F.size(distinct))


def multiset_recall(wanted: Column, got: Column) -> Column:
    """Share of the ``wanted`` tokens, counted with repeats, that ``got`` has; 1 if none are wanted."""
    kept = F.aggregate(
        F.array_distinct(wanted),
        F.lit(0),
        lambda n, t: n + F.least(F.size(F.filter(wanted, lambda x: x == t)), F.size(F.filter(got, lambda x: x == t))),
    )
    return F.when(F.size(wanted) == 0, 1.0).otherwise(kept / F.size(wanted))


def edit_ratio(a: Column, b: Column, first: int | None = None) -> Column:
    """Unit-cost edit distance over the longer length, of the first so many characters if given."""
    if first:
        a, b = F.left(a, F.lit(first)), F.left(b, F.lit(first))
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def canonical_label(text: Column) -> Column:
    """``Theorem 1.2`` from the first kind word with a number anywhere in the text; NULL if none."""
    shape = r"(?i)(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)\s+([\d.]+)"
    word, number = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    return F.when(word != "", F.concat(F.initcap(F.lower(word)), F.lit(" "), F.regexp_replace(number, r"\.+$", "")))


def lost_count(text: Column) -> Column:
    base = F.coalesce(text, F.lit(""))
    return F.length(base) - F.length(F.replace(base, F.lit(LOST), F.lit("")))


def delimiter_state(text: Column) -> Column:
    """struct(open, broken): closers still due, and whether a closer came that was not due.

    A fold over the delimiters alone; it stays as it is at the first wrong closer.
    """
    base = F.coalesce(text, F.lit(""))
    only = F.regexp_replace(base, r"[^()\[\]{}]+", "")
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("broken"))

    def step(state: Column, c: Column) -> Column:
        due = F.translate(c, "([{", ")]}")
        opened = F.struct(F.concat(due, state["open"]).alias("open"), F.lit(False).alias("broken"))
        closed = F.struct(F.substr(state["open"], F.lit(2)).alias("open"), F.lit(False).alias("broken"))
        wrong = F.struct(state["open"].alias("open"), F.lit(True).alias("broken"))
        return F.when(state["broken"] | (c == ""), state).when(c.isin("(", "[", "{"), opened).when(F.left(state["open"], F.lit(1)) == c, closed).otherwise(wrong)

    # Texts without delimiters (most of them) need no fold.
    return F.when(only == "", start).otherwise(F.aggregate(F.split(only, ""), start, step))


def balanced(text: Column) -> Column:
    state = delimiter_state(text)
    return ~state["broken"] & (state["open"] == "")


def suspicious_noise(text: Column) -> Column:
    """Lost characters, runs of look-alike strokes, or foreign runs in a text without σ and π."""
    base = F.coalesce(text, F.lit(""))
    foreign = base.rlike(r"[^\x00-\x7F]{4,}") & ~base.contains("σ") & ~base.contains("π")
    return base.contains(LOST) | base.rlike(r"\b[Il1]{5,}\b") | foreign


def formulas(text: Column) -> Column:
    """The formulas of a LaTeX text, delimiters included."""
    shape = r"(?s)\$\$.*?\$\$|\$[^$]+\$|\\\(.*?\\\)|\\\[.*?\\\]|\\begin\{(?:equation|align|gather|eqnarray)\*?\}.*?\\end\{(?:equation|align|gather|eqnarray)\*?\}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(shape), 0)


def repair_contexts(text: Column, window: int = 30) -> Column:
    """array<struct(pos, context)>: each lost character with the text around it, line ends as spaces.

    ``pos`` counts from 0. Texts without one give an empty array.
    """
    # The pieces between lost characters give the places; the text is split once, not looked at letter by letter.
    pieces = F.split(text, LOST, -1)
    ends = F.aggregate(F.transform(pieces, F.length), F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n + 1)))
    places = F.slice(ends, F.lit(1), F.size(pieces) - 1)
    around = lambda i: F.replace(F.substr(text, F.greatest(i - window, F.lit(1)), i + window + 1 - F.greatest(i - window, F.lit(1))), F.lit("\n"), F.lit(" "))
    return F.coalesce(F.transform(places, lambda i: F.struct((i - 1).alias("pos"), around(i).alias("context"))), F.array().cast("array<struct<pos:int,context:string>>"))


def apply_at(text: Column, fixes: Column) -> Column:
    """``text`` with the lost character at each position of the map ``fixes`` (from 0) replaced."""
    put = lambda c, i: F.when(c == LOST, F.coalesce(F.try_element_at(fixes, i), c)).otherwise(c)
    return F.when(text.contains(LOST), F.array_join(F.transform(F.split(text, ""), put), "")).otherwise(text)


def apply_once(text: Column, fixes: Column) -> Column:
    """struct(text, hits): each fix (find, replace) in turn replaces its first occurrence only."""
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("hits"))

    def step(state: Column, fix: Column) -> Column:
        at = F.position(fix["find"], state["text"])
        done = F.concat(F.substr(state["text"], F.lit(1), at - 1), fix["replace"], F.substr(state["text"], at + F.length(fix["find"])))
        return F.when((at > 0) & (fix["find"] != ""), F.struct(done.alias("text"), (state["hits"] + 1).alias("hits"))).otherwise(state)

    return F.aggregate(fixes, start, step)


def int_list(text: Column, strict: bool = True) -> Column:
    """Integers of a list like ``1, 2;3``. Strict: other entries raise an error; else they are left out."""
    parts = F.filter(F.split(strip(text), r"[,\s;]+"), lambda x: x != "")
    if strict:
        return F.transform(parts, lambda x: x.cast("int"))
    return F.filter(F.transform(parts, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def valid_blocks(text: Column, valid: Column) -> Column:
    """Block ids of a list in text form: known ones only, each once, order kept."""
    return F.array_distinct(F.filter(int_list(F.regexp_replace(text, r"[\[\]\"]", " "), strict=False), lambda x: F.array_contains(valid, x)))


def formula_spans(texts: Column, blocks: Column, prefix: Column) -> Column:
    """Spans from ``||``-separated texts and a block list; a count mismatch raises an error."""
    parts = F.filter(F.transform(F.split(F.coalesce(texts, F.lit("")), r"\|\|"), strip), lambda x: x != "")
    ids = int_list(blocks)
    spans = F.transform(
        F.zip_with(parts, ids, lambda t, b: F.struct(t.alias("text"), b.alias("source_block"))),
        lambda s, i: F.struct(F.format_string("f_%s_%02d", prefix, i + 1).alias("formula_id"), s["text"].alias("text"), s["source_block"].alias("source_block")),
    )
    return F.when(F.size(parts) == F.size(ids), spans).otherwise(F.raise_error(F.lit("formula texts and formula blocks differ in number")))


def confidence(value: Column, default: float = 0.5) -> Column:
    """A confidence in any form, clamped to [0, 1] and rounded to 4 places."""
    return F.round(F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(default)), F.lit(0.0)), F.lit(1.0)), 4)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two texts; two empty texts are alike. No built-in has it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)


def sequence_distance(a: Column, b: Column) -> Column:
    """The complement of :func:`sequence_ratio`, of whole texts."""
    return 1 - sequence_ratio(a, b)


def compared(text: Column, first: int = 300) -> Column:
    """What :func:`similarity` compares of a text: its first so many characters in small letters."""
    return F.left(F.lower(F.coalesce(text, F.lit(""))), F.lit(first))


def similarity(a: Column, b: Column, first: int = 300) -> Column:
    """:func:`sequence_ratio` of the first so many characters in small letters."""
    return sequence_ratio(compared(a, first), compared(b, first))


def json_array(raw: Column) -> Column:
    """The JSON array in a model's answer: fences off, else from the first ``[`` to the last ``]``; NULL if none."""
    bare = strip(F.regexp_replace(strip(raw), r"^```(?:json)?\s*|\s*```$", ""))
    return F.when(bare.startswith("["), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit("")))


def _first_value(text: str | None) -> str | None:
    if text is None:
        return None
    decode = json.JSONDecoder().raw_decode
    for at, c in enumerate(text):
        if c in "[{":
            try:
                return text[at : at + decode(text[at:])[1]]
            except ValueError:
                continue
    return None


@F.pandas_udf(StringType())
def json_blob(raw: pd.Series) -> pd.Series:
    """The first whole JSON object or array inside a text, strings and escapes respected; NULL if none."""
    return pd.Series([_first_value(t) for t in raw], dtype=object)
