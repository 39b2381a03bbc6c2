"""Evaluation beside label matching: block-form scores, annotator agreement, label changes, data checks and error counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import scores as S
from folioscope.functions import text as T
from folioscope.operators import match, metrics
from folioscope.operators.dedup import keep_first

SPANS = "array<struct<formula_id:string,text:string,source_block:int>>"


def block_form(units: DataFrame) -> DataFrame:
    """Env-form units as block-form ones: unit_id, doc_id, page_id, unit_type, statement_text, formula_spans, source_blocks, reading_order."""
    order = F.col("reading_order") if "reading_order" in units.columns else F.col("_source_blocks")
    return units.select(
        "unit_id", F.col("_doc_id").alias("doc_id"), F.col("_page_id").alias("page_id"), metrics.env_type(F.col("env")).alias("unit_type"), F.col("content").alias("statement_text"),
        F.coalesce("_formula_spans", F.array().cast(SPANS)).alias("formula_spans"), F.coalesce("_source_blocks", F.array().cast("array<int>")).alias("source_blocks"), F.coalesce(order, F.array().cast("array<int>")).alias("reading_order"),
    )


def span_blocks(spans: Column) -> Column:
    """The set of blocks that formula spans point at, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(spans, lambda s: s["source_block"]), lambda b: b.isNotNull())))


def structure(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: boundary precision, recall and F1 over distinct (page, first, last) blocks, type and block agreement where both have one.

    ``gold`` and ``pred`` are in block form; of units with one boundary the last counts.
    """
    page = list(dict.fromkeys([*keys, "page_id"]))

    def side(df: DataFrame, n: str) -> DataFrame:
        edged = df.select(*page, match.boundary(F.col("source_blocks")).alias("edge"), F.col("unit_id").alias(f"id_{n}"), F.col("unit_type").alias(f"type_{n}"), F.col("source_blocks").alias(f"blocks_{n}"))
        return keep_first(edged, [*page, "edge"], [F.col(f"id_{n}").desc()])

    both = side(gold, "g").join(side(pred, "p"), [*page, "edge"], "full_outer")
    common = F.col("id_g").isNotNull() & F.col("id_p").isNotNull()
    overlap = T.jaccard(F.array_distinct("blocks_g"), F.array_distinct("blocks_p"), 1.0)
    per = both.groupBy(*keys).agg(
        F.count_if(common).alias("common"), F.count("id_g").alias("gold"), F.count("id_p").alias("pred"),
        F.coalesce(F.avg(F.when(common, F.col("type_g").eqNullSafe(F.col("type_p")).cast("double"))), F.lit(0.0)).alias("unit_type_accuracy"),
        F.coalesce(F.avg(F.when(common, overlap)), F.lit(0.0)).alias("block_assignment_accuracy"),
    )
    p, r = metrics.ratio(F.col("common"), F.col("pred")), metrics.ratio(F.col("common"), F.col("gold"))
    return per.select(*keys, p.alias("boundary_precision"), r.alias("boundary_recall"), metrics.f1(p, r).alias("boundary_f1"), "unit_type_accuracy", "block_assignment_accuracy")


def _paired(pairs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    g = gold.select(F.col("unit_id").alias("gold_id"), *[F.col(c).alias(f"g_{c}") for c in ("doc_id", "statement_text", "formula_spans")])
    p = pred.select(F.col("unit_id").alias("pred_id"), *[F.col(c).alias(f"p_{c}") for c in ("doc_id", "page_id", "unit_type", "statement_text", "formula_spans", "source_blocks", "reading_order")])
    return pairs.join(g, "gold_id").join(p, "pred_id")


def integrity(paired: DataFrame) -> DataFrame:
    """Per book of the gold units: matched units, formula attachment, statement completeness (tokens with repeats) and full edit distance."""
    a, b = T.normalize_statement(F.col("g_statement_text")), T.normalize_statement(F.col("p_statement_text"))
    return paired.groupBy(F.col("g_doc_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("matched_unit_count"),
        F.avg((span_blocks(F.col("g_formula_spans")) == span_blocks(F.col("p_formula_spans"))).cast("double")).alias("formula_attachment_accuracy"),
        F.avg(T.multiset_recall(T.symbol_tokens(a), T.symbol_tokens(b))).alias("statement_completeness"),
        F.avg(T.edit_ratio(a, b)).alias("normalized_edit_distance"),
    )


def downstream(gold: DataFrame, paired: DataFrame) -> DataFrame:
    """Per book: parse, symbol and retrieval scores of the matched predictions and their mean, a gold unit without a partner counting 0."""
    p = lambda c: F.col(f"p_{c}")
    order = (p("doc_id"), p("page_id"), p("unit_type"), p("statement_text"), p("source_blocks"), p("reading_order"))
    texts = F.transform("p_formula_spans", lambda s: s["text"])
    scored = paired.select("gold_id", S.blk_parse(*order).alias("parse"), S.blk_symbol(p("statement_text"), texts, p("reading_order")).alias("symbol"), S.blk_retrieval(*order).alias("retrieval"))
    scored = scored.withColumn("ready", (F.col("parse") + F.col("symbol") + F.col("retrieval")) / 3)
    every = gold.select("doc_id", F.col("unit_id").alias("gold_id")).join(scored, "gold_id", "left")
    names = {"parse": "structured_parse_success", "symbol": "symbol_stability", "retrieval": "retrieval_compatibility", "ready": "formalization_readiness"}
    return every.groupBy("doc_id").agg(F.count("parse").alias("matched_over_all_gold"), *[F.avg(F.coalesce(c, F.lit(0.0))).alias(n) for c, n in names.items()])


def evaluate_blocks(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per book (doc_id): structure, integrity and downstream scores in one record, as shares.

    ``gold`` and ``pred`` are env-form units, ``pairs`` (gold_id, pred_id) from :func:`match.match_blocks`. Books without a
    matched pair have 0 everywhere and edit distance 1.
    """
    g, p = block_form(gold), block_form(pred)
    paired = _paired(pairs, g, p)
    out = structure(g, p, ["doc_id"]).join(integrity(paired), "doc_id", "left").join(downstream(g, paired), "doc_id", "left").drop("matched_over_all_gold")
    worst = {"normalized_edit_distance": 1.0}
    return out.select("doc_id", *[F.coalesce(F.col(c), F.lit(0 if c == "matched_unit_count" else worst.get(c, 0.0))).alias(c) for c in out.columns if c != "doc_id"])


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets; 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(common == 0, 0.0).otherwise(2 * common / (F.size(a) + F.size(b)))


def pooled_agreement(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row over all books: boundary precision, recall and F1 of annotator b against a, type agreement, formula and content token F1.

    ``pairs`` (gold_id, pred_id) are matched per book; pairs are pooled.
    """
    side = lambda df, n: df.select(F.col("unit_id").alias(f"{n}_id"), F.col("env").alias(f"{n}_env"), F.col("content").alias(f"{n}_content"))
    both = pairs.join(side(a, "gold"), "gold_id").join(side(b, "pred"), "pred_id")
    formula = lambda n: F.array_distinct(F.flatten(F.transform(T.formulas(F.col(f"{n}_content")), T.token_set)))
    blank = F.lit("")
    scored = both.agg(
        F.count(F.lit(1)).alias("matched"),
        F.coalesce(F.avg((F.coalesce("gold_env", blank) == F.coalesce("pred_env", blank)).cast("double")), F.lit(0.0)).alias("type"),
        F.coalesce(F.avg(token_f1(formula("gold"), formula("pred"))), F.lit(0.0)).alias("formula"),
        F.coalesce(F.avg(token_f1(T.token_set(F.col("gold_content")), T.token_set(F.col("pred_content")))), F.lit(0.0)).alias("content"),
    )
    counts = scored.withColumn("units_a", F.lit(a.count()).cast("bigint")).withColumn("units_b", F.lit(b.count()).cast("bigint"))
    p, r = metrics.ratio(F.col("matched"), F.col("units_b")), metrics.ratio(F.col("matched"), F.col("units_a"))
    return counts.select("units_a", "units_b", "matched", p.alias("precision"), r.alias("recall"), metrics.f1(p, r).alias("f1"), "type", "formula", "content")


def label_changes(old: DataFrame, new: DataFrame, book: str = "_doc_id", first: int = 50) -> DataFrame:
    """(book, label, change): labels added, removed or changed between two annotations, of repeated labels the last.

    ``change`` lists what differs: env, content (its first characters), proof (there or not), numbers.
    """
    def side(df: DataFrame, n: str) -> DataFrame:
        kept = keep_first(df.where(F.col("label").isNotNull()), [book, "label"], [F.col("unit_id").desc()])
        return kept.select(book, "label", F.col("env").alias(f"env_{n}"), F.left(F.coalesce("content", F.lit("")), F.lit(first)).alias(f"content_{n}"), (F.coalesce("proof", F.lit("")) != "").alias(f"proof_{n}"), F.col("number_components").alias(f"numbers_{n}"), F.lit(1).alias(f"in_{n}"))

    both = side(old, "o").join(side(new, "n"), [book, "label"], "full_outer")
    differs = [F.when(~F.col(f"{c}_o").eqNullSafe(F.col(f"{c}_n")), c) for c in ("env", "content", "proof", "numbers")]
    change = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "removed").otherwise(F.concat_ws(",", *differs))
    return both.select(book, "label", change.alias("change")).where("change <> ''")


def missed_and_extra(gold: DataFrame, pred: DataFrame, book: str = "_doc_id") -> DataFrame:
    """(book, key, side): canonical labels that only one side has: ``missed`` by the prediction, or ``extra`` in it."""
    both = match.match_labels_v1(gold, pred, book).where("gold_id IS NULL OR pred_id IS NULL")
    return both.select(book, "key", F.when(F.col("pred_id").isNull(), "missed").otherwise("extra").alias("side"))


def error_counts(units: DataFrame, gold_method: str, pairs: DataFrame) -> DataFrame:
    """Per method: gold units missed (fn), units beyond the matched ones (fp), lost characters, units below full parse and symbol score.

    ``pairs``: (method, gold_id, pred_id) of every method against the gold units.
    """
    matched = pairs.groupBy("method").agg(F.count(F.lit(1)).alias("matched"))
    gold = F.lit(units.where(F.col("method") == gold_method).count()).cast("bigint")
    c = F.col
    text = F.concat(F.coalesce("content", F.lit("")), F.coalesce("proof", F.lit("")))
    own = units.where(F.col("method") != gold_method).groupBy("method").agg(
        F.count(F.lit(1)).alias("units"), F.sum(T.lost_count(text)).alias("lost"),
        F.count_if(S.v2_parse(c("label"), c("env"), c("content"), c("number_components")) < 1).alias("parse_errors"), F.count_if(S.v2_symbol(c("content"), c("proof")) < 1).alias("symbol_errors"),
    )
    found = F.coalesce("matched", F.lit(0))
    return own.join(matched, "method", "left").select("method", (gold - found).alias("fn"), (F.col("units") - found).alias("fp"), "lost", "parse_errors", "symbol_errors")


def lost_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(stage, units, damaged, lost, batches): lost characters before and after a repair, and the batches of eight it needs."""
    text = F.concat(F.coalesce("content", F.lit("")), F.coalesce("proof", F.lit("")))
    one = lambda df, n: df.agg(F.lit(n).alias("stage"), F.count(F.lit(1)).alias("units"), F.count_if(T.lost_count(text) > 0).alias("damaged"), F.coalesce(F.sum(T.lost_count(text)), F.lit(0)).alias("lost"))
    return one(before, "before").unionByName(one(after, "after")).withColumn("batches", F.ceil(F.col("units") / 8))


def data_checks(units: DataFrame, gold_method: str, pairs: DataFrame) -> DataFrame:
    """(method, rule, n): the data checks of predictions and gold as counts.

    Rules: ``units``, ``count_delta`` (books whose number of units is not the gold's), ``empty`` and ``short`` contents, ``with_blocks``,
    ``environments`` and ``dollars`` (LaTeX in the content), ``with_formulas``, ``label_mismatch`` and ``env_mismatch`` of matched pairs,
    ``missing_books`` (gold books without a unit of the method).
    """
    text = F.trim(F.coalesce("content", F.lit("")))
    raw = F.coalesce("content", F.lit(""))
    rules = {
        "units": F.lit(True),
        "empty": text == "",
        "short": (text != "") & (F.length(text) < 10),
        "with_blocks": F.coalesce(F.size("_source_blocks"), F.lit(0)) > 0,
        "environments": raw.contains("\\begin{") | raw.contains("\\end{"),
        "dollars": raw.contains("$"),
        "with_formulas": F.size(T.formulas(F.col("content"))) > 0,
    }
    counted = units.groupBy("method").agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    own = counted.unpivot(["method"], list(rules), "rule", "n")
    per_book = units.groupBy("method", "_doc_id").agg(F.count(F.lit(1)).alias("units"))
    gold = per_book.where(F.col("method") == gold_method).select("_doc_id", F.col("units").alias("gold"))
    others = per_book.where(F.col("method") != gold_method).join(gold, "_doc_id")
    both = others.groupBy("method").agg(F.count_if(F.col("units") != F.col("gold")).alias("count_delta"), F.count(F.lit(1)).alias("books"))
    books = F.lit(gold.count()).cast("bigint")
    compared = both.select("method", "count_delta", (books - F.col("books")).alias("missing_books")).unpivot(["method"], ["count_delta", "missing_books"], "rule", "n")
    side = lambda n: units.select(F.col("unit_id").alias(f"{n}_id"), F.col("label").alias(f"{n}_label"), F.col("env").alias(f"{n}_env"))
    matched = pairs.join(side("gold"), "gold_id").join(side("pred"), "pred_id").groupBy("method").agg(
        F.count_if(~F.col("gold_label").eqNullSafe(F.col("pred_label"))).alias("label_mismatch"), F.count_if(~F.col("gold_env").eqNullSafe(F.col("pred_env"))).alias("env_mismatch")
    )
    return own.unionByName(compared).unionByName(matched.unpivot(["method"], ["label_mismatch", "env_mismatch"], "rule", "n"))


def split_totals(summary: DataFrame, split: str, counts: list[str]) -> DataFrame:
    """(measure, parts, total): the counts whose splits don't add up to the row of the whole (``split`` NULL)."""
    long = summary.select(split, F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in counts]), F.array(*[F.col(c).cast("bigint") for c in counts]))).alias("measure", "n"))
    sums = long.groupBy("measure").agg(F.sum(F.when(F.col(split).isNotNull(), F.col("n"))).alias("parts"), F.max(F.when(F.col(split).isNull(), F.col("n"))).alias("total"))
    return sums.where(~F.col("parts").eqNullSafe(F.col("total")))
