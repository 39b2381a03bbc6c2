"""Parsing of unit labels and citations into (kind, number)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.vocab import BLANKS, KIND_ABBREVIATIONS, KINDS

_SHAPE = rf"^(?:{BLANKS}|[\(\[\*'\"])*(\p{{L}}+)\.?{BLANKS}*(\d+(?:\.\d+)*)"


def _kind_map() -> Column:
    words = {k: k for k in KINDS} | KIND_ABBREVIATIONS
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(words.items())])


def parse_kind(text: Column) -> Column:
    """Kind word of a label or citation in any spelling (``Thm.``, ``THEOREM``); NULL if it has none."""
    word = F.lower(F.regexp_extract(text, _SHAPE, 1))
    return F.try_element_at(_kind_map(), word)


def parse_number(text: Column) -> Column:
    """Full number (``1.4.2``) behind the kind word, without sub-item, name or final stop; NULL if none."""
    return F.nullif(F.regexp_extract(text, _SHAPE, 2), F.lit(""))


def canonical_number(text: Column) -> Column:
    """:func:`parse_number` with leading zeros of each piece removed, so that ``1.04`` equals ``1.4``."""
    return F.regexp_replace(parse_number(text), r"(^|\.)0+(?=\d)", "$1")
