"""Model answers to candidates and validated block-form units, and the annotation CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.dedup import keep_first
from folioscope.vocab import TYPE_ALIASES

ANSWER = "array<struct<page_id:string,unit_type:string,title:string,statement_text:string,source_blocks:string,reading_order:string,confidence_score:string,formula_spans:string,doc_id:string,notes:string>>"
SPAN_ITEM = "struct<text:string,source_block:string>"


def canonical_type(value: Column) -> Column:
    """Unit type of any known spelling, ``other`` for the rest."""
    word = F.lower(T.strip(value))
    return F.coalesce(*[F.when(word == a, t) for a, t in TYPE_ALIASES.items()], F.lit("other"))


def parse_answers(raw: DataFrame) -> DataFrame:
    """(page_id, seq, item struct) of the raw answers: a list, one object, or an object with ``units``. Unreadable ones give none."""
    blob = T.json_blob(F.col("raw_output"))
    text = F.coalesce(F.get_json_object("blob", "$.units"), F.when(F.col("blob").startswith("{"), F.concat(F.lit("["), F.col("blob"), F.lit("]"))).otherwise(F.col("blob")))
    return raw.withColumn("blob", blob).where("blob IS NOT NULL").select(*[c for c in ("doc_id", "notes") if c in raw.columns], "page_id", "candidate_source_blocks", "valid_ids", F.posexplode(F.from_json(text, ANSWER)).alias("seq", "item"))


def stage1(raw: DataFrame) -> DataFrame:
    """(doc_id if given, page_id, candidate_id, source_blocks): candidates with at least one valid block, each block list once per page.

    ``raw``: (doc_id if there are several books, page_id, raw_output, candidate_source_blocks, valid_ids). The page of the record holds, not the answer's.
    """
    items = parse_answers(raw).withColumn("source_blocks", T.valid_blocks(F.col("item.source_blocks"), F.col("valid_ids"))).where(F.size("source_blocks") > 0)
    page = [c for c in ("doc_id", "page_id") if c in raw.columns]
    once = keep_first(items, [*page, "source_blocks"], [F.col("seq")])
    number = F.row_number().over(Window.partitionBy(*page).orderBy("seq"))
    return once.select(*page, F.format_string("cand_%s_%02d", F.col("page_id"), number).alias("candidate_id"), "source_blocks")


def answered_spans(raw: Column, page: Column, valid: Column) -> Column:
    """Formula spans of an answer: a list of objects or texts, one object, or one text.

    Blanks are collapsed; spans without text or without a known block are left out; ids number the
    answer's list, so they may have gaps.
    """
    bare = F.trim(F.coalesce(raw, F.lit("")))
    listed = F.when(bare.startswith("["), bare).when(bare.startswith("{"), F.concat(F.lit("["), bare, F.lit("]"))).otherwise(F.lit("[]"))
    # Entries of one list may be of several kinds, so each is read on its own.
    entries = F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))
    objects = F.transform(entries, lambda e: F.from_json(e, SPAN_ITEM))
    numbered = F.transform(objects, lambda s, i: F.struct(F.format_string("f_%s_%02d", page, i + 1).alias("formula_id"), T.collapse(s["text"]).alias("text"), s["source_block"].try_cast("int").alias("source_block")))
    return F.filter(numbered, lambda s: (s["text"] != "") & F.coalesce(F.array_contains(valid, s["source_block"]), F.lit(False)))


def page_block_ids(pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, valid_ids): the block ids of each page; a block without one goes by its place."""
    ids = F.transform(F.coalesce("blocks", F.array()), lambda b, i: F.coalesce(b["block_id"], i))
    return pages.select("doc_id", "page_id", ids.alias("valid_ids"))


def with_valid_ids(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Raw answers with the block ids of their page, none where the page is unknown."""
    keys = ["doc_id", "page_id"] if "doc_id" in answers.columns else ["page_id"]
    known = page_block_ids(pages).groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("valid_ids"))).alias("valid_ids"))
    return answers.join(known, keys, "left").withColumn("valid_ids", F.coalesce("valid_ids", F.array().cast("array<int>")))


def stage2(raw: DataFrame) -> DataFrame:
    """Validated units: (doc_id, page_id, unit_id, unit_type, title, statement_text, formula_spans, source_blocks, reading_order, confidence_score, notes).

    Missing blocks fall back to the candidate's; a reading order must be among the blocks, else it is
    the blocks; blank statements and units without blocks are dropped; of equal units the most confident stays.
    """
    items = parse_answers(raw)
    own = T.valid_blocks(F.col("item.source_blocks"), F.col("valid_ids"))
    fallback = F.filter(F.coalesce("candidate_source_blocks", F.array().cast("array<int>")), lambda x: F.array_contains("valid_ids", x))
    given = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"item.{c}"), F.lit("")) if c in items.columns else F.coalesce(f"item.{c}", F.lit(""))
    units = items.select("page_id", "seq", given("doc_id").alias("doc_id"), given("notes").alias("notes"), answered_spans(F.col("item.formula_spans"), F.col("page_id"), F.col("valid_ids")).alias("formula_spans"), canonical_type(F.col("item.unit_type")).alias("unit_type"), T.collapse(F.col("item.title")).alias("title"), T.collapse(F.col("item.statement_text")).alias("statement_text"), F.when(F.size(own) > 0, own).otherwise(fallback).alias("source_blocks"), T.valid_blocks(F.col("item.reading_order"), F.col("valid_ids")).alias("ro"), T.confidence(F.col("item.confidence_score")).alias("confidence_score"))
    inside = (F.size("ro") > 0) & (F.size(F.array_except("ro", "source_blocks")) == 0)
    units = units.withColumn("reading_order", F.when(inside, F.col("ro")).otherwise(F.col("source_blocks"))).drop("ro").where((F.col("statement_text") != "") & (F.size("source_blocks") > 0))
    best = keep_first(units.withColumn("norm", F.lower("statement_text")), ["doc_id", "page_id", "source_blocks", "unit_type", "norm"], [F.col("confidence_score").desc(), F.col("seq")]).drop("norm")
    number = F.row_number().over(Window.partitionBy("doc_id", "page_id").orderBy("source_blocks", "seq"))
    return best.withColumn("unit_id", F.format_string("pred_%s_%02d", F.col("page_id"), number)).drop("seq")


def annotation_units(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Gold units of the annotation CSV (all columns text). Rows whose status is not '', done or reviewed are left out.

    Strict: a bad row raises an error. Else bad rows are left out (see :func:`annotation_rejects`).
    """
    ready = rows.where(F.lower(T.strip(F.col("status"))).isin("", "done", "reviewed"))
    if not strict:
        ready = ready.where(_sound())
    blocks = T.int_list(F.col("source_blocks"))
    order = T.int_list(F.col("reading_order"))
    kind = F.when(canonical_type(F.col("unit_type")) == F.lower(T.strip(F.col("unit_type"))), canonical_type(F.col("unit_type"))).otherwise(F.raise_error(F.concat(F.lit("unknown unit type: "), F.coalesce("unit_type", F.lit("")))))
    return ready.select("page_id", "unit_id", kind.alias("unit_type"), T.collapse(F.col("title")).alias("title"), T.collapse(F.col("statement_text")).alias("statement_text"), T.formula_spans(F.col("formula_span_texts"), F.col("formula_source_blocks"), F.col("page_id")).alias("formula_spans"), blocks.alias("source_blocks"), F.when(F.size(order) > 0, order).otherwise(blocks).alias("reading_order"), T.strip(F.col("notes")).alias("notes"))


def _sound() -> Column:
    listed = lambda c: F.coalesce(T.strip(F.col(c)), F.lit("")).rlike(r"^[\d,\s;]*$")
    parts = F.size(F.filter(F.split(F.coalesce("formula_span_texts", F.lit("")), r"\|\|"), lambda x: x.rlike(r"\S")))
    ids = F.size(F.filter(F.split(F.coalesce("formula_source_blocks", F.lit("")), r"[,\s;]+"), lambda x: x != ""))
    known = canonical_type(F.col("unit_type")) == F.lower(T.strip(F.col("unit_type")))
    return listed("source_blocks") & listed("reading_order") & listed("formula_source_blocks") & (parts == ids) & known & F.col("source_blocks").rlike(r"\d") & F.col("statement_text").rlike(r"\S")


def annotation_rejects(rows: DataFrame) -> DataFrame:
    """The rows a lenient import leaves out."""
    return rows.where(F.lower(T.strip(F.col("status"))).isin("", "done", "reviewed") & ~F.coalesce(_sound(), F.lit(False)))
