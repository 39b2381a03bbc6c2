"""Descriptive statistics, consistency checks, diagnostics and mock predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

FORMULA_DENSE = r"(?i)[=∑∫∀∃≤≥λμσπ]|\\[a-zA-Z]+|\bmath\b"


def page_features(pages: DataFrame) -> DataFrame:
    """(scan_id, doc_id, page_id, pdf_page_no, ocr_block_count, has_formula_dense, has_proof_adjacent)."""
    texts = F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit("")))
    dense = F.size(F.filter(texts, lambda t: t.rlike(FORMULA_DENSE)))
    return pages.select(
        "scan_id", "doc_id", "page_id", F.nullif(F.regexp_extract("page_id", r"(\d+)$", 1), F.lit("")).alias("pdf_page_no"), F.size("blocks").alias("ocr_block_count"),
        ((F.size("blocks") > 0) & (dense >= 0.2 * F.size("blocks"))).cast("int").alias("has_formula_dense"),
        F.lower(F.array_join(texts, " ")).contains("proof").cast("int").alias("has_proof_adjacent"),
    )


def manifest(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Page features with the first image path of the page's name, if any. ``images``: (path)."""
    named = images.select("path", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("page_id")).groupBy("page_id").agg(F.min("path").alias("image_path"))
    return page_features(pages).join(named, "page_id", "left")


def detached_heading(title: Column, blocks: Column) -> Column:
    """Whether a titled unit's second block does not follow its first."""
    gap = F.get(blocks, F.lit(1)) - F.get(blocks, F.lit(0))
    return F.coalesce((F.coalesce(title, F.lit("")) != "") & (F.size(blocks) >= 2) & (gap > 1), F.lit(False))


def descriptive(units: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: tokens and formulas per unit, shares of detached headings and of units noted as adjacent to a proof, mean confidence (NULL ones left out)."""
    noted = F.coalesce("notes", F.lit("")).rlike("(?i)proof_adjacent|adjacent_to_proof")
    return units.groupBy(*keys).agg(
        F.avg(F.size(T.symbol_tokens(F.col("content"), lower=False))).alias("avg_tokens_per_unit"),
        F.avg(F.greatest(F.coalesce(F.size("_formula_spans"), F.lit(0)), F.lit(0))).alias("avg_formulas_per_unit"),
        F.avg(detached_heading(F.col("label"), F.col("_source_blocks")).cast("int")).alias("detached_heading_ratio"),
        F.avg(noted.cast("int")).alias("proof_adjacent_ratio"), F.avg("confidence_score").alias("avg_ocr_confidence"),
    )


def split_summary(units: DataFrame, split: str, kind: str, blocks: str, spans: str) -> DataFrame:
    """Per split and in total (split NULL): units, types, blocks and formulas per unit, share of multi-block units."""
    like = F.col(kind).isin("theorem", "lemma", "proposition", "corollary")
    return units.rollup(split).agg(
        F.count(F.lit(1)).alias("theorem_units"), F.count_if(F.col(kind) == "definition").alias("definitions"), F.count_if(like).alias("theorem_like"), F.count_if(F.col(kind) == "example").alias("examples"),
        F.avg(F.greatest(F.size(blocks), F.lit(0))).alias("avg_blocks_per_unit"), F.avg(F.greatest(F.size(spans), F.lit(0))).alias("avg_formulas_per_unit"), F.avg((F.size(blocks) > 1).cast("int")).alias("multi_block_unit_ratio"),
    )


def block_diagnostics(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Per page: blocks, tiny ones, out-of-order neighbours and fragmented neighbours."""
    order = Window.partitionBy(*page).orderBy("pos")
    text = T.strip(F.col("text"))
    y0, y1, x0 = F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3)), F.get("bbox", F.lit(0))
    rows = blocks.select(*page, "pos", "block_type", text.alias("t"), y0.alias("y0"), y1.alias("y1"), x0.alias("x0"))
    nxt = lambda c: F.lead(c).over(order)
    rows = rows.withColumn("ny0", nxt("y0")).withColumn("nx0", nxt("x0")).withColumn("nt", nxt("t")).withColumn("nk", nxt("block_type"))
    body = F.col("block_type").isin("text", "formula") & F.col("nk").isin("text", "formula")
    broken = body & (F.abs(F.col("x0") - F.col("nx0")) < 5) & (F.abs(F.col("ny0") - F.col("y1")) < 5) & ~F.col("t").rlike(r"[.!?:;]$") & F.col("nt").rlike(r"^[a-z]")
    return rows.groupBy(*page).agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if((F.length("t") > 0) & (F.length("t") < 10) & (F.col("block_type") != "image")).alias("tiny"),
        F.count_if((F.col("ny0") < F.col("y0") - 20) & (F.col("ny0") > 50)).alias("out_of_order"), F.count_if(broken).alias("fragmented"),
    )


def violations(stats: DataFrame, key: str, total: str, parts: list[str]) -> DataFrame:
    """(key, rule, expected, found): rows whose parts don't sum to their total, and rows without a total."""
    whole = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    sums = stats.where(F.col(total).isNotNull() & (F.col(total) != whole)).select(key, F.lit("sum").alias("rule"), whole.cast("bigint").alias("expected"), F.col(total).cast("bigint").alias("found"))
    gaps = stats.where(F.col(total).isNull()).select(key, F.lit("missing").alias("rule"), whole.cast("bigint").alias("expected"), F.lit(None).cast("bigint").alias("found"))
    return sums.unionByName(gaps)


#: What a merged evaluation has to hold, and words that must not stay in a finished text.
MERGED = (
    "boundary_precision", "boundary_recall", "boundary_f1", "unit_type_accuracy", "block_assignment_accuracy", "formula_attachment_accuracy", "statement_completeness",
    "normalized_edit_distance", "structured_parse_success", "symbol_stability", "retrieval_compatibility", "formalization_readiness",
)
UNFINISHED = ("illustrative draft results", "replace with final", "placeholder", "todo", "tbd")


def missing_measures(results: DataFrame, required: tuple[str, ...] = MERGED) -> list[str]:
    """The measures an evaluation lacks, by its columns."""
    return [c for c in required if c not in results.columns]


def missing_files(df: DataFrame, column: str) -> DataFrame:
    """The distinct paths of ``column`` that don't exist, asked of their file systems once each."""
    spark = df.sparkSession
    paths = df.select(F.col(column).alias("path")).where("path IS NOT NULL").distinct()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf).exists(where)

    # Required files are a short list given by name, not data.
    return spark.createDataFrame([(r["path"],) for r in paths.toLocalIterator() if not there(r["path"])], "path string")


def unfinished_texts(texts: DataFrame, key: str, column: str, patterns: tuple[str, ...] = UNFINISHED) -> DataFrame:
    """(key, pattern): the texts that still hold one of ``patterns``, in any case."""
    found = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.regexp_like(F.lower(F.col(column)), p))
    return texts.select(key, F.explode(found).alias("pattern"))


def positional_diff(a: DataFrame, b: DataFrame, keys: list[str], field: str) -> DataFrame:
    """(keys, differs_at, delta): where the i-th records of two annotations first differ (from 0), and by what length."""
    j = a.select(*keys, F.coalesce(field, F.lit("")).alias("x")).join(b.select(*keys, F.coalesce(field, F.lit("")).alias("y")), keys).where("x <> y")
    same = F.zip_with(F.split("x", ""), F.split("y", ""), lambda p, q: p.eqNullSafe(q))
    return j.select(*keys, (F.array_position(same, False) - 1).alias("differs_at"), (F.length("y") - F.length("x")).alias("delta"))


def _coin(seed: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def mock_predictions(gold: DataFrame, how: str, seed: int = 42) -> DataFrame:
    """Predictions from gold: copy_gold, drop_formulas, truncate_blocks (last block off lists of two or more), minimal_noise."""
    if how == "copy_gold":
        return gold
    if how == "drop_formulas":
        return gold.withColumn("_formula_spans", F.slice("_formula_spans", 1, 0))
    if how == "truncate_blocks":
        return gold.withColumn("_source_blocks", F.when(F.size("_source_blocks") > 1, F.slice("_source_blocks", F.lit(1), F.size("_source_blocks") - 1)).otherwise(F.col("_source_blocks")))
    if how == "minimal_noise":
        noisy = F.when(_coin(seed, "unit_id") < 0.1, F.concat(F.coalesce("content", F.lit("")), F.lit(T.LOST))).otherwise(F.col("content"))
        return gold.withColumn("content", noisy)
    raise ValueError(f"unknown perturbation: {how}")
