"""Page layout: classification, noise, reading order and fragments, on the page's array of blocks.

Everything is a column expression over ``blocks``, so a page is cleaned where it is read, without a
shuffle. A block is struct(block_id, block_type, text, bbox array(x0, y0, x1, y1), font_size, is_bold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import strip

# Characters that make a block a formula.
MATH_CHARACTERS = "\\∀∃∈∉⊂⊃∪∩∅∞∑∏∫≤≥≠≈→←↔⇒⇐⇔∧∨¬∥⊥αβγδεζηθικλμνξπρστυφχψω"
KEYWORDS_OR_PROOF = r"(?i)^\s*(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise|Proof)\b"
SECTION = r"^\s*(\d+\.[\d.]*)\s+[A-Z]"
# Layout thresholds in points, and shares of the page height.
ROW_REACH, FOOTER_FROM, HEADER_TO, SMALL_FONT, DEFAULT_HEIGHT = 8.0, 0.91, 0.07, 9.5, 666.0


def classify(text: Column, font_size: Column) -> Column:
    """Block type from its text and size: empty, heading, theorem_heading, theorem_body, formula or text."""
    bare = strip(text)
    size = F.greatest(F.length(bare), F.lit(1))
    math = (F.length(bare) - F.length(F.translate(bare, MATH_CHARACTERS, ""))) / size
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]", "")) / size
    equation = (F.length(bare) < 120) & bare.rlike("[=≤≥]") & (letters < 0.4)
    return (
        F.when(bare == "", "empty")
        .when((font_size > 13) | (bare.rlike(SECTION) & (font_size > 11)), "heading")
        .when(bare.rlike(KEYWORDS_OR_PROOF), F.when(F.length(bare) < 200, "theorem_heading").otherwise("theorem_body"))
        .when((math > 0.3) | equation, "formula")
        .otherwise("text")
    )


def is_noise(block: Column, height: Column) -> Column:
    """Empty blocks, furniture at the page's edges in small type, and lone page numbers in small type."""
    text = strip(block["text"])
    small = F.coalesce(block["font_size"], F.lit(10.0)) < SMALL_FONT
    number = text.rlike(r"^\s*\d{1,4}\s*$")
    imprint = text.rlike(r"(?i)(©|DOI\s|ISBN\s|Springer|Universitext|10\.\d{4}/)")
    head = text.rlike(r"^\s*\d+\s+\d+\s+[A-Z]")
    bottom = F.coalesce(F.get(block["bbox"], F.lit(3)), F.lit(0.0)) > FOOTER_FROM * height
    top = F.coalesce(F.get(block["bbox"], F.lit(1)), F.lit(0.0)) < HEADER_TO * height
    return (text == "") | (small & ((bottom & imprint) | (top & head) | number))


def drop_noise(blocks: Column, height: Column) -> Column:
    return F.filter(blocks, lambda b: ~is_noise(b, F.coalesce(height, F.lit(DEFAULT_HEIGHT))))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(block: Column, i: int) -> Column:
    return F.coalesce(F.get(block["bbox"], F.lit(i)), F.lit(0.0))


def reading_order(blocks: Column, reach: float = ROW_REACH) -> Column:
    """Rows from top to bottom, each from left to right.

    A block opens a row if it starts more than ``reach`` below the row's first block (its anchor),
    not below its predecessor. Equal places keep their order.
    """
    placed = F.transform(blocks, lambda b, i: F.struct(_at(b, 1).alias("y"), i.alias("pos"), b.alias("b")))
    return _once(F.array_sort(placed), lambda ordered: _by_rows(ordered, reach))


def _by_rows(ordered: Column, reach: float) -> Column:
    row_type = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("x"), F.lit(0).alias("seq"))
    start = F.struct(F.filter(F.array(row_type), lambda r: F.lit(False)).alias("rows"), F.lit(-1e300).alias("anchor"), F.lit(-1).alias("row"))

    def step(s: Column, e: Column) -> Column:
        opens = e["y"] - s["anchor"] > reach
        row = F.when(opens, s["row"] + 1).otherwise(s["row"])
        entry = F.struct(row.alias("row"), _at(e["b"], 0).alias("x"), F.size(s["rows"]).alias("seq"))
        return F.struct(F.concat(s["rows"], F.array(entry)).alias("rows"), F.when(opens, e["y"]).otherwise(s["anchor"]).alias("anchor"), row.alias("row"))

    rows = F.array_sort(F.aggregate(ordered, start, step)["rows"])
    return F.transform(rows, lambda r: F.get(ordered, r["seq"])["b"])


def _starts(block: Column) -> Column:
    return block["text"].rlike(KEYWORDS_OR_PROOF) | block["block_type"].isin("theorem_heading", "theorem_body")


def joins(a: Column, b: Column) -> Column:
    """Whether block ``b`` continues block ``a``: small gaps, and one of them is a fragment or both share a line."""
    size_a, size_b = F.length(strip(a["text"])), F.length(strip(b["text"]))
    gap = _at(b, 1) - _at(a, 3)
    overlap = F.greatest(F.lit(0.0), F.least(_at(a, 2), _at(b, 2)) - F.greatest(_at(a, 0), _at(b, 0)))
    width = F.least(_at(a, 2) - _at(a, 0), _at(b, 2) - _at(b, 0))
    share = F.when(width > 0, overlap / width).otherwise(0.0)
    beside = _at(b, 0) - _at(a, 2)
    heading = (a["block_type"] == "heading") | (b["block_type"] == "heading")
    barred = heading | _starts(b) | ((size_a > 50) & (size_b > 50)) | (gap > 15) | (gap < -10)
    fragment = (size_a < 15) | (size_b < 15)
    stacked = (share > 0.3) & fragment
    same_line = (F.abs(_at(a, 1) - _at(b, 1)) < 8) & (beside < 20) & (beside > -5)
    specks = (size_a < 5) & (size_b < 5) & (gap < 10) & (F.abs(_at(a, 0) - _at(b, 0)) < 30)
    return F.coalesce(~barred & (stacked | same_line | specks), F.lit(False))


def _joined(a: Column, b: Column) -> Column:
    kind = (
        F.when(a["block_type"].contains("formula") | b["block_type"].contains("formula"), "formula")
        .when(a["block_type"].contains("theorem"), a["block_type"])
        .when(b["block_type"].contains("theorem"), b["block_type"])
        .otherwise(a["block_type"])
    )
    box = F.array(F.least(_at(a, 0), _at(b, 0)), F.least(_at(a, 1), _at(b, 1)), F.greatest(_at(a, 2), _at(b, 2)), F.greatest(_at(a, 3), _at(b, 3)))
    return F.struct(
        a["block_id"].alias("block_id"),
        kind.alias("block_type"),
        F.concat(strip(a["text"]), F.lit(" "), strip(b["text"])).alias("text"),
        box.alias("bbox"),
        F.greatest(F.coalesce(a["font_size"], F.lit(10.0)), F.coalesce(b["font_size"], F.lit(10.0))).alias("font_size"),
        (F.coalesce(a["is_bold"], F.lit(False)) | F.coalesce(b["is_bold"], F.lit(False))).alias("is_bold"),
    )


def merge_fragments(blocks: Column) -> Column:
    """Neighbours that continue each other as one block; each is held against what was merged so far."""
    return _once(blocks, _merged)


def _merged(blocks: Column) -> Column:
    tail = lambda done: F.get(done, F.size(done) - 1)

    def step(done: Column, b: Column) -> Column:
        last = tail(done)
        return F.when(joins(last, b), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(_joined(last, b)))).otherwise(F.concat(done, F.array(b)))

    return F.when(F.size(blocks) <= 1, blocks).otherwise(F.aggregate(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(1))), F.slice(blocks, 1, 1), step))


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Pages with noise dropped, blocks in reading order, fragments merged (twice) and ids from 0.

    Later columns each read the one before, so no expression is evaluated twice. NULL blocks count as none.
    """
    element = pages.schema["blocks"].dataType.elementType
    names = [f.name for f in element.fields]
    given = F.coalesce("blocks", F.array().cast(pages.schema["blocks"].dataType))
    shape = lambda b: F.struct(*[b[n].alias(n) for n in ("block_id", "block_type", "text", "bbox", "font_size", "is_bold")])
    renumber = lambda b, i: F.struct(*[(i.cast("int") if n == "block_id" else b[n]).alias(n) for n in names])
    ordered = F.transform(reading_order(drop_noise(given, F.col("page_height"))), shape)
    clean = F.transform(merge_fragments(merge_fragments(ordered)), renumber)
    both = _once(clean, lambda c: F.struct(c.alias("blocks"), F.size(c).alias("num_blocks")))
    return pages.withColumn("clean", both).withColumn("blocks", F.col("clean.blocks")).withColumn("num_blocks", F.col("clean.num_blocks")).drop("clean")


def latest_scans(pages: DataFrame) -> DataFrame:
    """One scan per (doc_id, page_id): the last one made, then the largest id. Only keys are shuffled before the choice."""
    best = pages.groupBy("doc_id", "page_id").agg(F.max_by("scan_id", F.struct("scanned_at", "scan_id")).alias("scan_id"))
    return pages.join(best.select("scan_id"), "scan_id", "left_semi")


def explode_blocks(pages: DataFrame) -> DataFrame:
    """A row per block with its place ``pos`` (from 0) in the page."""
    keep = [c for c in ("scan_id", "doc_id", "page_id", "page_index", "page_height") if c in pages.columns]
    return pages.select(*keep, F.posexplode("blocks").alias("pos", "b")).select(*keep, "pos", "b.*")


def span_style(spans: Column) -> Column:
    """struct(font_size, is_bold) of a block's spans: mean size (10 without spans), bold if most spans are."""
    n = F.size(spans)
    mean = F.aggregate(spans, F.lit(0.0), lambda s, x: s + x["size"]) / n
    bold = F.size(F.filter(spans, lambda x: F.lower(x["font"]).contains("bold")))
    return F.struct(F.when(n > 0, F.round(mean, 1)).otherwise(10.0).alias("font_size"), (bold * 2 > n).alias("is_bold"))


def assemble_page(raw: DataFrame) -> DataFrame:
    """OCR pages from raw blocks (doc_id, page_id, page_index, pos, is_image, lines array<array<struct<text,size,font>>>, bbox).

    Spans of a line are joined, lines by line ends, blanks off; empty blocks are skipped and ids run
    without gaps. Images have the text ``[image]`` and size 0.
    """
    text = strip(F.array_join(F.transform("lines", lambda line: F.array_join(F.transform(line, lambda s: s["text"]), "")), "\n"))
    style = span_style(F.flatten(F.coalesce("lines", F.array())))
    rounded = F.transform("bbox", lambda x: F.round(x, 1))
    shaped = raw.select(
        "doc_id", "page_id", "page_index", "pos",
        F.when(F.col("is_image"), "[image]").otherwise(text).alias("text"),
        F.when(F.col("is_image"), 0.0).otherwise(style["font_size"]).alias("font_size"),
        F.when(F.col("is_image"), False).otherwise(style["is_bold"]).alias("is_bold"),
        rounded.alias("bbox"), "is_image",
    ).where(F.col("text") != "")
    kind = F.when(F.col("is_image"), "image").otherwise(classify(F.col("text"), F.col("font_size")))
    packed = shaped.groupBy("doc_id", "page_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("pos", kind.alias("block_type"), "text", "bbox", "font_size", "is_bold"))).alias("found"))
    numbered = F.transform("found", lambda b, i: F.struct(i.cast("int").alias("block_id"), b["block_type"].alias("block_type"), b["text"].alias("text"), b["bbox"].alias("bbox"), b["font_size"].alias("font_size"), b["is_bold"].alias("is_bold")))
    return packed.select("doc_id", "page_id", "page_index", F.size("found").alias("num_blocks"), numbered.alias("blocks"))
