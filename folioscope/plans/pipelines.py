"""Composed pipelines: pages to units, and units to evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import dedup, layout, match, metrics, repair, segment
from folioscope.session import materialize


def rule_units(pages: DataFrame) -> DataFrame:
    """Units straight from the pages as read."""
    return segment.extract_units(layout.explode_blocks(pages))


def structure_units(pages: DataFrame) -> DataFrame:
    """Normalised pages, segmentation, the first unit of each label per book."""
    units = segment.extract_units(layout.explode_blocks(layout.normalize_pages(pages)))
    return dedup.keep_first(units, ["doc_id", "label"], [F.col("page_id"), F.col("unit_index")])


def repaired_units(units: DataFrame, make_client: Callable = repair.offline_client) -> DataFrame:
    """Units after one request per damaged field. The answers are written once before use."""
    answers = materialize(repair.ask(repair.symbol_requests(units), make_client))
    return repair.apply_symbol_answers(units, answers)


def process_pages(pages: DataFrame, make_client: Callable = repair.offline_client) -> tuple[DataFrame, DataFrame]:
    """(units, run statistics per book): normalised pages, segmentation, one request per damaged field, first of each label, numbered from 1."""
    units = segment.extract_units(layout.explode_blocks(layout.normalize_pages(pages)))
    units = materialize(units.withColumn("unit_id", F.xxhash64("doc_id", "page_id", "unit_index")))
    asked = repair.symbol_requests(units)
    answers = materialize(repair.ask(asked, make_client))
    fixed = repair.apply_symbol_answers(units, answers)
    first = dedup.keep_first(fixed, ["doc_id", "label"], [F.col("page_id"), F.col("unit_index")])
    numbered = first.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id", "unit_index")))
    owner = units.select("doc_id", F.col("unit_id").cast("string").alias("owner"))
    calls = answers.withColumn("owner", F.split("key", "/")[0]).join(owner, "owner").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("llm_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("seconds").alias("wall_time_seconds")
    )
    books = units.select("doc_id").distinct()
    return numbered, books.join(calls, "doc_id", "left").withColumn("llm_calls", F.coalesce("llm_calls", F.lit(0)))


def hybrid_units(units: DataFrame) -> DataFrame:
    """The longest record of each label per book, numbered by number components."""
    return dedup.reindex(dedup.longest_by_label(units, drop_blank=True))


def evaluate(gold: DataFrame, pred: DataFrame, family: str = "v2", book: str = "_doc_id") -> DataFrame:
    """Per book: boundary scores and content scores of ``pred`` against ``gold``. Family v2 compares whole texts."""
    if family == "v1":
        pairs = match.match_labels_v1(gold, pred, book).where("gold_id IS NOT NULL AND pred_id IS NOT NULL").select(book, "gold_id", "pred_id")
    else:
        pairs = match.match_units(gold, pred, book).select(book, "gold_id", "pred_id")
    pairs = materialize(pairs)
    scored = metrics.summary(metrics.pair_scores(metrics.with_units(pairs, gold, pred), family, 500 if family == "v1" else None), [book]).drop("matched")
    if family == "v1":
        # This family counts distinct labels, not units.
        one = lambda df, c: df.where(F.col(c).isNotNull()).select(book, "key").distinct()
        every = match.match_labels_v1(gold, pred, book)
        edges = metrics.boundary_scores(pairs, one(every, "gold_id"), one(every, "pred_id"), [book])
        books = gold.select(book).unionByName(pred.select(book)).distinct()
        edges = books.join(edges, book, "left").fillna(0)
    else:
        edges = metrics.boundary_scores(pairs, gold, pred, [book])
    # Without a matched pair every mean is 0, but the edit distance 1.
    worst = {"edit": 1.0}
    joined = edges.join(scored, book, "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit(worst.get(c, 0.0))).alias(c) if c in scored.columns and c != book else F.col(c) for c in joined.columns])


def evaluate_pooled(gold: DataFrame, pred: DataFrame, book: str = "_doc_id") -> DataFrame:
    """One row: units are matched per book, the pairs of all books scored together."""
    pairs = materialize(match.match_units(gold, pred, book).select("gold_id", "pred_id"))
    one = F.lit(1).alias("all")
    edges = metrics.boundary_scores(pairs.select(one), gold.select(one), pred.select(one), ["all"])
    scored = metrics.summary(metrics.pair_scores(metrics.with_units(pairs, gold, pred)).withColumn("all", F.lit(1)), ["all"]).drop("matched")
    return edges.join(scored, "all", "left").drop("all")


def rerun_needed(stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """(method, doc_id) of ``wanted`` without a run that used tokens."""
    done = stats.where(F.col("total_tokens") > 0).select("method", "doc_id").distinct()
    return wanted.select("method", "doc_id").distinct().join(done, ["method", "doc_id"], "left_anti")
