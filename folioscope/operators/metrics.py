"""Metric aggregates over matched pairs. Doubles are not rounded here; reports round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scores as S
from folioscope.functions import text as T
from folioscope.vocab import ENV_TO_TYPE, TYPE_GROUPS


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def env_type(env: Column) -> Column:
    """Type of an environment after collapsing; unknown ones are ``other``."""
    return F.coalesce(*[F.when(env == e, t) for e, t in ENV_TO_TYPE.items()], F.lit("other"))


def type_group(env: Column) -> Column:
    """The group of types an environment is reported in."""
    kind = env_type(env)
    return F.coalesce(*[F.when(kind.isin(*types), g) for g, types in TYPE_GROUPS.items()])


def with_units(pairs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs with the scored fields of both units as structs ``g`` and ``p``."""
    side = lambda df, fields: F.struct(*[c for c in fields if c in df.columns])
    g = gold.select(F.col("unit_id").alias("gold_id"), side(gold, ("env", "content")).alias("g"))
    p = pred.select(F.col("unit_id").alias("pred_id"), side(pred, ("label", "env", "content", "proof", "number_components", "context", "_formula_spans", "_doc_id", "_page_id")).alias("p"))
    return pairs.join(g, "gold_id").join(p, "pred_id")


def pair_scores(pairs: DataFrame, family: str = "v2", first: int | None = 500) -> DataFrame:
    """Per pair: type_ok, completeness, edit, formula, parse, symbol, retrieval, ready, of the family given.

    ``first``: how many characters the edit distance compares; None for whole texts.
    """
    g, p = (lambda c: F.col(f"g.{c}")), (lambda c: F.col(f"p.{c}"))
    gold_text, pred_text = T.strip_latex(g("content")), T.normalize_ocr(p("content"))
    spans = F.transform(F.coalesce(p("_formula_spans"), F.array().cast("array<struct<formula_id:string,text:string,source_block:int>>")), lambda s: s["text"])
    if family == "v2":
        same = g("env").eqNullSafe(p("env"))
        formula = formula_kept(g("content"), p("content"))
        parse = S.v2_parse(p("label"), p("env"), p("content"), p("number_components"))
        symbol = S.v2_symbol(p("content"), p("proof"))
        retrieval = S.v2_retrieval(p("label"), p("env"), p("content"), p("number_components"), F.col("p.context.section"), F.col("p.context.section_number"))
    else:
        same = env_type(g("env")) == env_type(p("env"))
        formula = formula_belongs(g("content"), spans)
        parse, symbol = S.v1_parse(p("label"), p("env"), p("content")), S.v1_symbol(p("content"), spans)
        retrieval = S.v1_retrieval(p("label"), p("env"), p("content"), p("_doc_id"), p("_page_id"))
    scored = pairs.select(
        *[c for c in pairs.columns if c not in ("g", "p")],
        g("env").alias("gold_env"),
        same.cast("int").alias("type_ok"),
        T.set_recall(T.tokens(gold_text), T.tokens(pred_text)).alias("completeness"),
        T.edit_ratio(gold_text, pred_text, first).alias("edit"),
        formula.alias("formula"), parse.alias("parse"), symbol.alias("symbol"), retrieval.alias("retrieval"),
    )
    return scored.withColumn("ready", (F.col("parse") + F.col("symbol") + F.col("retrieval")) / 3)


def formula_kept(gold: Column, pred: Column, legacy: bool = False) -> Column:
    """Share of the gold formulas more than half of whose tokens the prediction has; 1 without formulas.

    ``legacy``: the constant that older reports show.
    """
    if legacy:
        return F.lit(1.0)
    wanted = F.filter(F.transform(T.formulas(gold), T.token_set), lambda t: F.size(t) > 0)
    have = T.token_set(T.normalize_ocr(pred))
    hit = F.size(F.filter(wanted, lambda t: F.size(F.array_intersect(t, have)) / F.size(t) > 0.5))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(hit / F.size(wanted))


def formula_belongs(gold: Column, spans: Column) -> Column:
    """Share of the predicted spans more than 0.3 of whose tokens the gold text has; spans without tokens count.

    Without spans: 1 if the gold text has no display formula, else 0.
    """
    have = T.token_set(T.strip_latex(gold))
    hit = F.size(F.filter(spans, lambda s: T.set_recall(T.tokens(T.normalize_ocr(s)), have) > 0.3))
    display = F.coalesce(gold, F.lit("")).rlike(r"\$\$|\\begin\{(equation|align|gather)")
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, F.when(display, 0.0).otherwise(1.0)).otherwise(hit / F.size(spans))


SCORES = ("completeness", "edit", "formula", "parse", "symbol", "retrieval", "ready")


def summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and means per key."""
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"), F.avg("type_ok").alias("type_accuracy"), *[F.avg(s).alias(s) for s in SCORES])


def boundary_scores(matched: DataFrame, gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 per key from counts of pairs and of both sides."""
    m = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"))
    g = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("gold"))
    p = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("pred"))
    joined = g.join(p, keys, "full_outer").join(m, keys, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", "gold", "pred")]
    out = joined.select(*keys, *counts).withColumn("precision", ratio(F.col("matched"), F.col("pred"))).withColumn("recall", ratio(F.col("matched"), F.col("gold")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro(per_chapter: DataFrame, keys: list[str], measures: list[str], chapter_rows: str = "matched") -> DataFrame:
    """Mean, sample deviation (0 for one chapter), minimum and maximum over chapters that have rows."""
    aggs = [f.alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg(m)), ("std", F.coalesce(F.stddev_samp(m), F.lit(0.0))), ("min", F.min(m)), ("max", F.max(m)))]
    return per_chapter.where(F.col(chapter_rows) > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("chapters"), *aggs)


def bootstrap(per_chapter: DataFrame, measure: str, resamples: int = 10_000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(mean, low, high) of the mean over chapters by resampling them with replacement.

    Draws come from a linear congruential generator on (resample, draw), so they repeat anywhere; a resample is as
    many draws as there are chapters. The chapters' values, one double each, go to every task, which draws its
    resamples there: draws are never rows.
    """
    values = per_chapter.where(F.col(measure).isNotNull()).select(F.col(measure).cast("double").alias("v")).orderBy("v").toArrow()["v"].to_numpy()
    spark = per_chapter.sparkSession
    shared = spark.sparkContext.broadcast(values)
    prime = 2147483647
    twice = 48271 * 48271 % prime

    def drawn(batches):
        v = shared.value
        n = len(v)
        # The generator is linear: what a draw adds is the same in every resample.
        steps = (np.arange(n) * 104729 % prime) * twice % prime
        for batch in batches if n else ():
            ids = batch.column(0).to_pylist()
            means = [v[(steps + (b * 7919 + seed * 1299709) % prime * twice % prime) % prime % n].mean() for b in ids]
            yield pa.RecordBatch.from_pydict({"b": pa.array(ids, pa.int64()), "m": pa.array(means, pa.float64())})

    means = spark.range(resamples).mapInArrow(drawn, "b bigint, m double")
    ranked = means.withColumn("r", F.row_number().over(Window.orderBy("m")) - 1)
    at = lambda q: F.max(F.when(F.col("r") == int(q * resamples), F.col("m")))
    return ranked.agg(F.avg("m").alias("mean"), at(low).alias("low"), at(high).alias("high"))


def agreement(a: DataFrame, b: DataFrame, page: list[str]) -> DataFrame:
    """Per page and for the whole: boundary Jaccard, type agreement and formula agreement of two annotators.

    Pages without common units agree fully in type and formula. Duplicate boundaries of a page count once (the last).
    """
    from folioscope.operators.dedup import keep_first
    from folioscope.operators.match import boundary

    def side(df: DataFrame, n: str) -> DataFrame:
        spans = F.array_sort(F.array_distinct(F.transform(F.coalesce("_formula_spans", F.array().cast("array<struct<formula_id:string,text:string,source_block:int>>")), lambda s: s["source_block"])))
        keyed = df.select(*page, boundary(F.col("_source_blocks")).alias("edge"), F.col("env").alias(f"env_{n}"), spans.alias(f"f_{n}"), F.col("unit_id").alias(f"id_{n}"))
        return keep_first(keyed, [*page, "edge"], [F.col(f"id_{n}").desc()])

    both = side(a, "a").join(side(b, "b"), [*page, "edge"], "full_outer")
    common = F.col("id_a").isNotNull() & F.col("id_b").isNotNull()
    per = both.groupBy(*page).agg(
        F.count(F.lit(1)).alias("all"), F.count_if(common).alias("common"),
        F.count_if(common & F.col("env_a").eqNullSafe(F.col("env_b"))).alias("same_type"), F.count_if(common & (F.col("f_a") == F.col("f_b"))).alias("same_formula"),
    )
    vacuous = lambda part: F.when(F.col("common") > 0, F.col(part) / F.col("common")).otherwise(1.0)
    return per.select(*page, (F.col("common") / F.col("all")).alias("boundary"), vacuous("same_type").alias("type"), vacuous("same_formula").alias("formula"))
