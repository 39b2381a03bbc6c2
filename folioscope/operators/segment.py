"""Segmentation of page blocks into units by window functions over the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.vocab import KINDS, TYPE_TO_ENV

HEADING = r"(?i)^\s*(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)\s*([\d.]+)?"
PROOF = r"(?i)^\s*Proof\b"
PROOF_END = r"[□■∎]|\bQ\.?E\.?D\.?\b"
SECTION_PARTS = r"^(\d+)\.(\d+)\s+(.+)"
#: A page: its scan if there is one, so a page scanned twice is segmented twice.
PAGE = ["doc_id", "page_id"]


def is_proof_start(text: Column) -> Column:
    return strip(text).rlike(PROOF)


def is_start(text: Column, block_type: Column) -> Column:
    """A keyword at the start (no word end needed) or a block typed as theorem; never a proof."""
    return ~is_proof_start(text) & (strip(text).rlike(HEADING) | F.coalesce(block_type.isin("theorem_heading", "theorem_body"), F.lit(False)))


def is_heading(text: Column, block_type: Column, font_size: Column) -> Column:
    large = (F.coalesce(font_size, F.lit(10.0)) > 13) & strip(text).rlike(r"^\s*(\d+\.[\d.]*)\s+[A-Z]")
    return F.coalesce(block_type == "heading", F.lit(False)) | large


def unit_type(text: Column) -> Column:
    """Type of a starting block by its keyword, ``other`` without one."""
    word = F.lower(F.regexp_extract(strip(text), HEADING, 1))
    named = F.coalesce(*[F.when(word == k, t) for k, (t, _) in KINDS.items()])
    return F.coalesce(named, F.lit("other"))


def env_of(unit_type: Column) -> Column:
    return F.coalesce(*[F.when(unit_type == t, e) for t, e in TYPE_TO_ENV.items()])


def label_of(title: Column) -> Column:
    """``Kind N.M`` if the title begins so, else the title."""
    shape = r"(?i)^(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)\s+([\d.]+)"
    word, number = F.regexp_extract(title, shape, 1), F.regexp_extract(title, shape, 2)
    return F.when(word != "", F.concat(F.initcap(F.lower(word)), F.lit(" "), F.regexp_replace(number, r"\.+$", ""))).otherwise(title)


def number_pieces(label: Column) -> Column:
    """The pieces of a label's part behind the first space that are digits only."""
    tail = F.when(F.instr(label, " ") > 0, F.substr(label, F.instr(label, " ") + 1)).otherwise(F.lit(""))
    return F.transform(F.filter(F.split(tail, r"\."), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))


def carry_section(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_id, section, section_number): the last section heading up to and including each page.

    The last heading of a page holds for the whole page and is carried to the book's later pages. The
    window runs over pages, one row each.
    """
    first_line = F.split(strip(F.col("text")), "\n")[0]
    found = is_heading(F.col("text"), F.col("block_type"), F.col("font_size")) & first_line.rlike(SECTION_PARTS)
    part = F.struct(F.regexp_extract(first_line, SECTION_PARTS, 3).alias("section"), F.regexp_extract(first_line, SECTION_PARTS, 2).cast("int").alias("section_number"))
    per_page = blocks.groupBy(*PAGE).agg(F.max_by(F.when(found, part), F.when(found, F.col("pos"))).alias("heading"))
    so_far = Window.partitionBy("doc_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)
    return per_page.withColumn("heading", F.last("heading", ignorenulls=True).over(so_far)).select(*PAGE, F.coalesce("heading.section", F.lit("")).alias("section"), F.coalesce("heading.section_number", F.lit(0)).alias("section_number"))


def segment_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with their unit number ``unit`` on the page and ``part``: content, proof or NULL.

    Every start opens a unit; its content runs to the first heading or proof; a proof runs to the next
    heading, or through the first later block with an end mark. Images are no content.
    """
    order = Window.partitionBy(*PAGE).orderBy("pos")
    text, kind = F.col("text"), F.col("block_type")
    flagged = (
        blocks.withColumn("starts", is_start(text, kind))
        .withColumn("heads", is_heading(text, kind, F.col("font_size")))
        .withColumn("proves", is_proof_start(text))
        .withColumn("unit", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("unit > 0")
    )
    whole = Window.partitionBy(*PAGE, "unit")
    stopped = flagged.withColumn("stop", F.min(F.when(~F.col("starts") & (F.col("heads") | F.col("proves")), F.col("pos"))).over(whole))
    proof_at = F.min(F.when((F.col("pos") == F.col("stop")) & F.col("proves"), F.col("pos"))).over(whole)
    known = stopped.withColumn("proof_at", proof_at)
    later = F.col("pos") > F.col("proof_at")
    ended = known.withColumn("head_at", F.min(F.when(later & F.col("heads"), F.col("pos"))).over(whole)).withColumn("mark_at", F.min(F.when(later & F.col("text").rlike(PROOF_END), F.col("pos"))).over(whole))
    far = F.lit(2**31 - 1)
    in_proof = (F.col("pos") >= F.col("proof_at")) & (F.col("pos") < F.coalesce("head_at", far)) & (F.col("pos") <= F.coalesce("mark_at", far))
    in_content = F.col("starts") | ((F.coalesce("stop", far) > F.col("pos")) & (F.coalesce(F.col("block_type"), F.lit("")) != "image"))
    part = F.when(in_content, "content").when(F.coalesce(in_proof, F.lit(False)), "proof")
    return ended.withColumn("part", part).drop("stop", "proof_at", "head_at", "mark_at", "heads", "proves")


def extract_units(pages_blocks: DataFrame) -> DataFrame:
    """Units in env form from a row per block (one scan per page): see :func:`segment_blocks`.

    Columns: doc_id, page_id, unit_index (from 1 on its page), label, env, number_components, content,
    proof, source_blocks, proof_blocks, formula_spans, section, section_number.
    """
    parts = segment_blocks(pages_blocks).where("part IS NOT NULL")
    entry = F.struct("pos", F.col("block_id").alias("id"), strip(F.col("text")).alias("text"), F.col("block_type").alias("kind"))
    grouped = parts.groupBy(*PAGE, "unit").agg(
        F.max(F.when(F.col("starts"), strip(F.col("text")))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("part") == "content", entry))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("part") == "proof", entry))).alias("p"),
    )
    joined = lambda a: F.array_join(F.filter(F.transform(a, lambda b: b["text"]), lambda t: t != ""), " ")
    title = strip(F.split("head", "\n")[0])
    label = label_of(title)
    spans = F.transform(F.filter("c", lambda b: b["kind"] == "formula"), lambda b, i: F.struct(F.format_string("f_%s_%02d", F.col("page_id"), i + 1).alias("formula_id"), b["text"].alias("text"), b["id"].alias("source_block")))
    units = grouped.select(
        *PAGE, F.col("unit").cast("int").alias("unit_index"), label.alias("label"), env_of(unit_type(F.col("head"))).alias("env"), number_pieces(label).alias("number_components"),
        joined("c").alias("content"), joined("p").alias("proof"),
        F.transform("c", lambda b: b["id"]).alias("source_blocks"), F.transform("p", lambda b: b["id"]).alias("proof_blocks"), spans.alias("formula_spans"),
    )
    return units.join(carry_section(pages_blocks), PAGE)
