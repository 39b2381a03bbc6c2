"""Visually identical text with different characters.

The canonical form is computed by DuckDB inside the Arrow partitions: width forms, invisible
characters, kinds of blank and letters of another script are mapped in SQL, accents are composed
by ``nfc_normalize``. Superscripts, double-struck letters and look-alikes inside one script stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialize

# Greek and Cyrillic letters that have the shape of a Latin letter.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
GREEK_AS = "ABEZHIKMNOPTYXo"
CYRILLIC = "АВЕКМНОРСТХЅІЈаеорсухѕіјһԁԛԝ"
CYRILLIC_AS = "ABEKMHOPCTXSIJaeopcyxsijhdqw"

#: Characters without a visible shape, as a class of DuckDB's regular expressions.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
#: Kinds of blank of the width of about one space; line ends are visible and stay.
BLANK = r"[\t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _width_forms() -> tuple[str, str]:
    """Full- and half-width characters and their plain forms, from the compatibility mappings."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xFF01, 0xFFEF)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str) -> str:
    """The DuckDB expression of the canonical form of ``column``."""
    wide, plain = _width_forms()
    visible = f"regexp_replace({column}, '{INVISIBLE}', '', 'g')"
    narrow = f"translate({visible}, {_quoted(wide)}, {_quoted(plain)})"
    latin = f"translate(nfc_normalize({narrow}), '{GREEK + CYRILLIC}', '{GREEK_AS + CYRILLIC_AS}')"
    return f"trim(regexp_replace(nfc_normalize({latin}), '{BLANK}', ' ', 'g'))"


def _through_duckdb(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        base = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            base.register("batch", pa.Table.from_batches([batch]))
            yield from base.sql(sql).to_arrow_table().to_batches()
            base.unregister("batch")

    return run


def canonical_text(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, canonical): the consistent form of each text; NULL stays NULL, blank becomes ''."""
    kind = df.schema[id_column].dataType.simpleString()
    sql = f"SELECT id, {canonical_sql('text')} AS canonical FROM batch"
    inner = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return inner.mapInArrow(_through_duckdb(sql), f"id {kind}, canonical string").withColumnRenamed("id", id_column)


def canonical_keys(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, look, form): 128-bit digests of the canonical form and of the text as it is coded.

    Texts that are NULL or show nothing have no look and are left out.
    """
    sql = f"SELECT id, md5(c) AS look, md5(text) AS form FROM (SELECT id, text, {canonical_sql('text')} AS c FROM batch) WHERE c <> ''"
    inner = df.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    return inner.mapInArrow(_through_duckdb(sql), "id bigint, look string, form string")


def same_look_classes(keys: DataFrame) -> DataFrame:
    """(look, form, representative, members) of the looks that are coded in two or more forms.

    Exact copies are folded into their form before anything is shuffled by look.
    """
    forms = keys.groupBy("look", "form").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("members"))
    mixed = forms.groupBy("look").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("look")
    return forms.join(mixed, "look", "left_semi")


def same_look_members(df: DataFrame, id_column: str = "unit_id", text_column: str = "content") -> DataFrame:
    """(unit_id, class_id, form_id, forms, records): membership in the looks that are coded in two or more forms.

    ``class_id`` is the smallest id of the look, ``form_id`` of the form; ``forms`` and ``records`` count the
    look's. One row per record however many copies a look has; pairs follow from it (:func:`same_look_pairs`).
    """
    keys = materialize(canonical_keys(df, id_column, text_column))
    forms = same_look_classes(keys)
    looks = forms.groupBy("look").agg(F.count(F.lit(1)).alias("forms"), F.sum("members").alias("records"), F.min("representative").alias("class_id"))
    listed = forms.join(looks, "look").select("look", "form", "class_id", F.col("representative").alias("form_id"), "forms", "records")
    return keys.join(listed, ["look", "form"]).select(F.col("id").alias("unit_id"), "class_id", "form_id", "forms", "records").distinct()


def same_look_pairs(df: DataFrame, id_column: str = "unit_id", text_column: str = "content") -> DataFrame:
    """(unit_id_a, unit_id_b): texts that look the same and are coded differently, a below b.

    Each record is paired with the representative (smallest id) of every other form of its look, so
    exact copies add a row per form, not per copy; a look coded anew in every copy has a row for each two
    of them, as each two are a case (:func:`same_look_members` has one row per record). Repeated ids count once.
    """
    keys = materialize(canonical_keys(df, id_column, text_column))
    classes = materialize(same_look_classes(keys))
    members = keys.join(classes.select("look").distinct(), "look", "left_semi")
    other = classes.select("look", F.col("form").alias("other_form"), "representative")
    return (
        members.join(other, "look")
        .where("form <> other_form AND id <> representative")
        .select(F.least("id", "representative").alias("unit_id_a"), F.greatest("id", "representative").alias("unit_id_b"))
        .distinct()
    )
