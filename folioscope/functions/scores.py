"""Unit scorers of the three metric families: sums of deductions, held in [0, 1].

v2: env-form units, graded deductions. v1: env-form units, coarse. blk: block-form units. NULL fields count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import LOST, balanced, delimiter_state, lost_count, strip, suspicious_noise
from folioscope.vocab import VALID_ENVS_V1, VALID_ENVS_V2, VALID_TYPES


def _less(*deductions: tuple[Column, float]) -> Column:
    score = F.lit(1.0)
    for when, by in deductions:
        score = score - F.when(when, by).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def _no(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _none(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) <= 0


def _not_in(value: Column, valid: tuple[str, ...]) -> Column:
    return ~F.coalesce(value, F.lit("")).isin(*valid)


def v2_parse(label: Column, env: Column, content: Column, numbers: Column) -> Column:
    lost = lost_count(content)
    short = F.coalesce(label, F.lit("")).rlike(r"^(Theorem|Definition|Lemma|Corollary|Proposition)\s+\d+\.\s*$")
    return _less((_no(label), 0.15), (_not_in(env, VALID_ENVS_V2), 0.15), (strip(content) == "", 0.3), (_none(numbers), 0.1), (lost > 3, 0.2), ((lost > 0) & (lost <= 3), 0.1), (short, 0.15))


def v2_symbol(content: Column, proof: Column) -> Column:
    text = F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(proof, F.lit("")))
    lost = lost_count(text)
    ratio = lost / F.greatest(F.length(text), F.lit(1))
    return _less(
        (ratio > 0.05, 0.4),
        ((ratio > 0.01) & (ratio <= 0.05), 0.25),
        ((lost > 0) & (ratio <= 0.01), 0.1),
        (~balanced(text), 0.25),
        (text.rlike(r"(Springer|DOI\s*10\.\d|Universitext|©)"), 0.2),
        (F.length(strip(text)) < 10, 0.15),
    )


def v2_retrieval(label: Column, env: Column, content: Column, numbers: Column, section: Column, section_number: Column) -> Column:
    text = strip(content)
    size = F.length(text)
    ratio = lost_count(text) / F.greatest(size, F.lit(1))
    no_context = _no(section) & (F.coalesce(section_number, F.lit(0)) == 0)
    return _less(
        (_no(label), 0.15),
        (_not_in(env, VALID_ENVS_V2), 0.15),
        (size < 20, 0.25),
        ((size >= 20) & (size < 50), 0.1),
        (ratio > 0.03, 0.2),
        ((ratio > 0.01) & (ratio <= 0.03), 0.1),
        (_none(numbers), 0.1),
        (no_context, 0.15),
    )


def v1_parse(label: Column, env: Column, content: Column) -> Column:
    return F.when(_no(label) | _no(env) | (strip(content) == ""), 0.0).otherwise(1.0)


def v1_symbol(content: Column, span_texts: Column) -> Column:
    """A wrong closer and closers still due at that moment are deducted separately."""
    spans = F.coalesce(F.array_join(F.transform(span_texts, lambda t: F.concat(F.lit(" "), F.coalesce(t, F.lit("")))), ""), F.lit(""))
    text = F.concat(F.coalesce(content, F.lit("")), spans)
    state = delimiter_state(text)
    return _less((text.contains(LOST), 0.35), (state["broken"], 0.35), (state["open"] != "", 0.35), (F.length(strip(text)) < 10, 0.15))


def v1_retrieval(label: Column, env: Column, content: Column, doc_id: Column, page_id: Column) -> Column:
    return _less((_no(label), 0.2), (_no(env), 0.2), (_not_in(env, VALID_ENVS_V1), 0.2), (strip(content) == "", 0.2), (_no(doc_id), 0.1), (_no(page_id), 0.1))


def blk_parse(doc_id: Column, page_id: Column, unit_type: Column, statement: Column, blocks: Column, order: Column) -> Column:
    bad = _no(doc_id) | _no(page_id) | _not_in(unit_type, VALID_TYPES) | (strip(statement) == "") | _none(blocks) | _none(order)
    return F.when(bad, 0.0).otherwise(1.0)


def blk_symbol(statement: Column, span_texts: Column, order: Column) -> Column:
    spans = F.coalesce(F.array_join(span_texts, " ", ""), F.lit(""))
    text = strip(F.concat(F.coalesce(statement, F.lit("")), F.lit(" "), spans))
    twice = F.coalesce(F.size(order) != F.size(F.array_distinct(order)), F.lit(False))
    score = _less((~balanced(text), 0.35), (suspicious_noise(text), 0.35), (F.length(strip(statement)) < 10, 0.15), (twice, 0.15))
    return F.when(text == "", 0.0).otherwise(score)


def blk_retrieval(doc_id: Column, page_id: Column, unit_type: Column, statement: Column, blocks: Column, order: Column) -> Column:
    return _less((_no(doc_id), 0.2), (_no(page_id), 0.2), (_not_in(unit_type, VALID_TYPES), 0.2), (_none(blocks), 0.2), (_none(order), 0.1), (strip(statement) == "", 0.1))
