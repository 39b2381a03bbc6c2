"""Text cut off by field limits.

Cut lengths show as spikes of the discrete length hazard (the share of values that end at a length
among those that reach it). Each hazard is tested against the hazards of its neighbourhood, in
characters and in bytes, under false-discovery control. Values broken off in transfer have no length in
common, so the significant lengths are also what teaches how a cut value ends: a class of endings
counts as incomplete elsewhere only if it is no rarer at the significant lengths than at others. An
ending that contradicts the record itself (half a kind word, fewer numbers than the record has, an
open name) is incomplete by itself; a final one never is.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folioscope.functions.labels import parse_number
from folioscope.session import materialize
from folioscope.vocab import BLANKS, KIND_ABBREVIATIONS, KINDS

_TRIM = r"[\s   -   　​⁠﻿]+$"
_CLOSERS = r"[\"'”’»)\]）】*_]*"
# A sentence is final with a stop, but not with the dots of a sum that goes on, nor with an ellipsis.
_STOP = rf"[.!?．。！？]{_CLOSERS}$"
_OPEN_SUM = r"([+*·,<=≤≥−＋-]\s*|\s>\s*)[.．]{1,3}$|[.．][.．]$|…$"
_END_MARK = r"[∎□■]\)?$|(?i)\bq\.?e\.?d\.?$"
_END_MARKUP = r"</[A-Za-z][A-Za-z0-9]*\s*>$|<(?:br|hr|BR|HR)\s*/?>$|-->$|```$|~~~$|\|\}$|\]\]$|\}\}$|\\\]$|\\\)$|[^\s$]\s?\$\$?$|\\end\{[A-Za-z]+\*?\}$|(?m:^)[ \t]*\|[^\n]*\|\z|\n(?:={3,}|-{3,})$|\]\([^()\s]+\)$"
# A formula after the last colon behind a word is whole if it has a relation, ends with an operand and its brackets close.
_COLON_FORMULA = r"(?s)^.*\p{L}{2,}\s?[:：]\s*(.*)$"
_PROSE = r"\p{L}{4,}|\.\s+\p{Lu}"
_RELATION = r"[=<>≤≥∈⊂⊃≠→∼≅:]"
_OPERAND_END = r"[\p{L}\p{N}²³}\])|‖∅]$"


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.translate(text, character, ""))


def _balanced(text: Column) -> Column:
    pairs = [_count(text, a) == _count(text, b) for a, b in ("()", "[]", "{}")]
    bars = F.regexp_replace(text, r"\{[^}]*\}", "")
    return pairs[0] & pairs[1] & pairs[2] & (_count(bars, "|") % 2 == 0) & (_count(bars, "‖") % 2 == 0)


def content_final(text: Column) -> Column:
    """Whether the text ends with a full stop, an end mark or a closed piece of markup."""
    end = F.regexp_replace(text, _TRIM, "")
    return (end.rlike(_STOP) & ~end.rlike(_OPEN_SUM)) | end.rlike(_END_MARK) | end.rlike(_END_MARKUP)


def content_ends_in_formula(text: Column) -> Column:
    """Whether the text ends with a colon and a whole formula."""
    formula = F.trim(F.regexp_extract(F.regexp_replace(text, _TRIM, ""), _COLON_FORMULA, 1))
    return (F.length(formula) >= 3) & ~formula.rlike("[?!]") & ~formula.rlike(_PROSE) & formula.rlike(_RELATION) & formula.rlike(_OPERAND_END) & ~formula.rlike(_OPEN_SUM) & _balanced(formula)


def _label_parts(label: Column, numbers: Column) -> tuple[Column, Column, Column, Column]:
    """(text, number pieces, whether it is in itself cut, whether it ends in a number) of a label."""
    text = F.trim(F.regexp_replace(label, rf"{BLANKS}+", " "))
    word = F.lower(F.regexp_extract(text, r"^(\p{L}+)", 1))
    begins = F.lit(False)
    for w in KINDS:
        begins = begins | F.lit(w).startswith(word)
    number = parse_number(text)
    pieces = F.when(number.isNotNull(), F.size(F.split(number, r"\."))).otherwise(0)
    bare = text.rlike(r"^\p{L}+$")
    half_word = bare & ~word.isin(*KINDS) & begins
    no_number = bare & word.isin(*KINDS) & (F.coalesce(F.size(numbers), F.lit(0)) > 0)
    named = word.isin(*KINDS, *KIND_ABBREVIATIONS) & number.isNotNull() & text.rlike(r"[\d.]$")
    half_number = named & (F.size(numbers) > 0) & (pieces < F.size(numbers))
    half_name = (_count(text, "(") > _count(text, ")")) | text.rlike(r"\($")
    return text, pieces, F.coalesce(half_word | no_number | half_number | half_name, F.lit(False)) & (text != ""), named


def label_broken(label: Column, numbers: Column, depth: Column) -> Column:
    """Whether a label breaks off inside its kind word, number or name.

    ``numbers`` are the unit's number components as delivered apart from the label, NULL if unknown;
    ``depth`` is the usual count of components of such labels in the book, NULL if unknown.
    """
    text, pieces, cut, named = _label_parts(label, numbers)
    unknown = F.coalesce(F.size(numbers), F.lit(0)) <= 0
    return cut | (F.coalesce(named & unknown & (pieces < depth), F.lit(False)) & (text != ""))


def label_ending(label: Column, numbers: Column, depth: Column) -> Column:
    """``open`` (cut by its own record's evidence), ``short`` (fewer numbers than usual, the record's own unknown) or ``final``."""
    _, _, cut, _ = _label_parts(label, numbers)
    return F.when(cut, "open").when(label_broken(label, numbers, depth), "short").otherwise("final")


def content_ending(text: Column) -> Column:
    """``final`` (plainly whole), ``formula`` (whole formula behind a colon), ``open`` (an ellipsis, or a sum that
    goes on), else what it ends in: ``letter``, ``digit`` or ``sign``."""
    end = F.regexp_replace(text, _TRIM, "")
    last = F.when(end.rlike(_OPEN_SUM), "open").when(end.rlike(r"\p{L}$"), "letter").when(end.rlike(r"\p{N}$"), "digit").otherwise("sign")
    return F.when(content_final(text), "final").when(content_ends_in_formula(text), "formula").otherwise(last)


def field_values(units: DataFrame) -> DataFrame:
    """(unit_id, method, field_name, chars, bytes, ending): a row per non-blank value.

    NULL and blank values are no values. A NULL method is its own source.
    """
    base = units.select("unit_id", "method", F.col("_doc_id").alias("doc"), "label", "content", "number_components")
    kind = F.lower(F.regexp_extract("label", r"^\s*(\p{L}{2})", 1))
    shape = base.select("doc", kind.alias("kind2"), F.size(F.split(parse_number(F.col("label")), r"\.")).alias("pieces")).where("pieces > 0")
    # The usual depth per book and kind: map-side counts, then the commonest.
    usual = shape.groupBy("doc", "kind2", "pieces").count().groupBy("doc", "kind2").agg(F.max_by("pieces", F.struct("count", "pieces")).alias("depth"))
    unknown = F.coalesce(F.size("number_components"), F.lit(0)) <= 0
    need = unknown & F.col("label").isNotNull() & F.col("label").rlike(r"\d\.?\s*$")
    labels = base.where(F.col("label").rlike(r"\S")).drop("content")
    known = labels.where(~need).withColumn("depth", F.lit(None).cast("int"))
    guessed = labels.where(need).withColumn("kind2", kind).join(usual, ["doc", "kind2"], "left").drop("kind2")
    both = known.unionByName(guessed)
    sizes = lambda c: [F.length(c).alias("chars"), F.octet_length(c).alias("bytes")]
    of_labels = both.select("unit_id", "method", F.lit("label").alias("field_name"), *sizes(F.col("label")), label_ending(F.col("label"), F.col("number_components"), F.col("depth")).alias("ending"))
    content = F.col("content")
    of_contents = base.where(content.rlike(r"\S")).select("unit_id", "method", F.lit("content").alias("field_name"), *sizes(content), content_ending(content).alias("ending"))
    return of_labels.unionByName(of_contents)


@F.pandas_udf(DoubleType())
def _tail(ended: pd.Series, risk: pd.Series, hazard: pd.Series) -> pd.Series:
    """Chance of ``ended`` or more ends among ``risk`` values at this hazard (Poisson tail)."""

    def one(k: float, n: float, h: float) -> float:
        mean = max(n * h, 1e-9)
        if k <= 0 or k <= mean:
            return 1.0
        first = -mean + k * math.log(mean) - math.lgamma(k + 1)
        total, term, j = 1.0, 1.0, k
        while term > 1e-12 * total and j < k + 10_000:
            j += 1
            term *= mean / j
            total += term
        return min(1.0, math.exp(max(first, -700.0)) * total)

    return pd.Series([one(*x) for x in zip(ended, risk, hazard)])


def significant_lengths(values: DataFrame, reach: int = 12, gap: int = 3, fdr: float = 0.001, least_ratio: float = 4.0, least_hazard: float = 0.02) -> DataFrame:
    """(method, field_name, measure, length, ended, hazard, expected, q): the lengths at which too many values end unfinished.

    The hazard of a length is the share of the values reaching it that end there without a final
    ending. Neighbours are the lengths up to ``reach`` away but not within ``gap`` (a limit in bytes leaves
    the values that end in a longer character a little shorter). The tests of all sources, fields and
    measures are corrected together (Benjamini-Hochberg); a limit also ends at least ``least_hazard``
    of what reaches it. Windows run over length counts, never rows.
    """
    counted = (
        values.select("method", "field_name", (F.col("ending") == "final").alias("final"), F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("measure", "length"))
        .groupBy("method", "field_name", "measure", "length")
        .agg(F.count_if(~F.col("final")).alias("ended"), F.count(F.lit(1)).alias("values"))
    )
    by_length = Window.partitionBy("method", "field_name", "measure").orderBy("length")
    risk = F.sum("values").over(by_length.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = [by_length.rangeBetween(-reach, -gap - 1), by_length.rangeBetween(gap + 1, reach)]
    gone = sum((F.coalesce(F.sum("ended").over(w), F.lit(0)) for w in near), F.lit(0))
    span = 2 * (reach - gap)
    tested = (
        counted.withColumn("risk", risk)
        .withColumn("around", gone)
        .withColumn("expected", (F.col("around") + 0.5) / (span * F.greatest(F.col("risk"), F.lit(1))))
        .withColumn("hazard", F.col("ended") / F.col("risk"))
        .where("ended > 0")
        .withColumn("p", _tail(F.col("ended").cast("double"), F.col("risk").cast("double"), F.col("expected")))
    )
    rank = Window.orderBy("p", "method", "field_name", "measure", "length")
    # One row per source, field and length: the ranking is of counts, not of values.
    q = F.min(F.col("p") * F.col("tests") / F.col("rank")).over(rank.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = tested.withColumn("rank", F.row_number().over(rank)).withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy()))
    return (
        ranked.withColumn("q", q)
        .where((F.col("q") <= fdr) & (F.col("hazard") >= least_ratio * F.col("expected")) & (F.col("hazard") >= least_hazard) & (F.col("ended") >= 5))
        .select("method", "field_name", "measure", "length", "ended", "hazard", "expected", "q")
    )


class Endings:
    """What the significant lengths say of each class of endings."""

    #: Classes that are incomplete or whole by themselves; the others are judged by the lengths.
    SURE = {"open": True, "final": False}

    def __init__(self, counts: list):
        """``counts``: rows (field_name, ending, at_limit, n)."""
        self.n: dict[tuple, int] = {(r["field_name"], r["ending"], r["at_limit"]): r["n"] for r in counts}

    def evidence(self, field: str, ending: str) -> float | None:
        """Log ratio of how often the class stands at significant lengths and how often it would by its share elsewhere."""
        at = sum(n for (f, _, limit), n in self.n.items() if f == field and limit)
        off = sum(n for (f, _, limit), n in self.n.items() if f == field and not limit)
        if not at:
            return None
        expected = at * self.n.get((field, ending, False), 0) / max(off, 1)
        return math.log((self.n.get((field, ending, True), 0) + 1) / (expected + 1))

    def incomplete(self, least: float = -0.1) -> list[tuple[str, str]]:
        """The (field, class) that count as incomplete at any length: no significant length speaks against them.

        A whole formula counts only where the lengths speak for it (it ends many whole texts); without any
        significant length there is nothing to learn from, and the other classes count as they stand.
        """
        out = []
        for field, ending in sorted({(f, e) for f, e, _ in self.n}):
            evidence = self.evidence(field, ending)
            sure = self.SURE.get(ending)
            learned = evidence is not None and evidence > 1.0 if ending == "formula" else evidence is None or evidence >= least
            if sure if sure is not None else learned:
                out.append((field, ending))
        return out


def _flagged(units: DataFrame, hazards: bool = True) -> DataFrame:
    values = materialize(field_values(units))
    spikes = materialize(significant_lengths(values) if hazards else significant_lengths(values).limit(0))
    out = values
    # Significant lengths are a handful per source and field; whether they are broadcast is left to the planner.
    for measure in ("chars", "bytes"):
        at = spikes.where(F.col("measure") == measure).select(F.col("method").alias("m"), F.col("field_name").alias("f"), F.col("length").alias(f"spike_{measure}")).distinct()
        out = out.join(at, F.col("method").eqNullSafe(F.col("m")) & (F.col("field_name") == F.col("f")) & (F.col(measure) == F.col(f"spike_{measure}")), "left").drop("m", "f")
    out = out.withColumn("at_limit", F.col("spike_chars").isNotNull() | F.col("spike_bytes").isNotNull())
    endings = Endings(out.groupBy("field_name", "ending", "at_limit").agg(F.count(F.lit(1)).alias("n")).collect())
    listed = [F.concat_ws("/", F.lit(f), F.lit(e)) for f, e in endings.incomplete()]
    broken = F.concat_ws("/", "field_name", "ending").isin(*listed) if listed else F.lit(False)
    at_limit = F.col("at_limit") & ~F.col("ending").isin("final", "formula")
    return out.withColumn("at_limit", at_limit | (F.col("at_limit") & broken)).withColumn("cut", F.col("at_limit") | broken)


def cut_values(units: DataFrame, hazards: bool = True) -> DataFrame:
    """(unit_id, field_name): the values that were cut off. Repeated unit ids give a row each time they occur.

    ``hazards`` = False leaves out the test of the lengths, for comparison.
    """
    return _flagged(units, hazards).where("cut").select("unit_id", "field_name")


def cut_rates(units: DataFrame) -> DataFrame:
    """Per method and field: values, those cut, those of them at a significant length (the others broke off in transfer), and the share cut."""
    return (
        _flagged(units)
        .groupBy("method", "field_name")
        .agg(F.count(F.lit(1)).alias("values"), F.count_if("cut").alias("cut"), F.count_if("at_limit").alias("cut_at_limit"))
        .withColumn("share_cut", F.col("cut") / F.col("values"))
    )
