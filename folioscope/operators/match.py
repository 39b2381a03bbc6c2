"""Matching of predicted with reference units: by label, by wording, by block boundary.

Greedy one-to-one matching depends on order. Candidate pairs come from a block (book or page) and an
inverted index of tokens or blocks, are cut to those above the threshold, and only these short lists
are folded, a connected component at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import canonical_label, jaccard, tokens
from folioscope.operators.dedup import keep_first
from folioscope.session import materialize


def match_labels_v1(gold: DataFrame, pred: DataFrame, book: str = "_doc_id") -> DataFrame:
    """Full outer join on canonical labels. Of gold duplicates the last counts, of predicted ones the longest.

    Columns: book, key, gold_id, pred_id (NULL where one side is missing). A predicted unit without label
    goes by its title, if there is such a column.
    """
    named = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("title")) if "title" in pred.columns else F.col("label")
    g = gold.select(book, canonical_label(F.col("label")).alias("key"), F.col("unit_id").alias("gold_id")).where("key IS NOT NULL")
    p = pred.select(book, canonical_label(named).alias("key"), F.col("unit_id").alias("pred_id"), F.length(F.coalesce("content", F.lit(""))).alias("size")).where("key IS NOT NULL")
    g = keep_first(g, [book, "key"], [F.col("gold_id").desc()])
    p = keep_first(p, [book, "key"], [F.col("size").desc(), F.col("pred_id")]).drop("size")
    return g.join(p, [book, "key"], "full_outer")


def match_labels_v2(gold: DataFrame, pred: DataFrame, book: str = "_doc_id") -> DataFrame:
    """(book, key, gold_id, pred_id): level 1, the labels both sides have."""
    return match_labels_v1(gold, pred, book).where("gold_id IS NOT NULL AND pred_id IS NOT NULL")


#: Units of either side in a cell of :func:`_similar_pairs`; pairs (and tokens looked up) that are counted at once.
CELL, AT_ONCE = 8_192, 1 << 22


def _similar_pairs(gold: DataFrame, pred: DataFrame, book: str, threshold: float) -> DataFrame:
    """(book, gold_id, pred_id, sim) of pairs whose token sets have a Jaccard above ``threshold``.

    Books are dealt to cells, and a book with more than ``CELL`` units of a side is cut to a grid of them, in which every
    part of its golds meets every part of its predictions. A cell counts common tokens over an inverted index.
    """
    side = lambda df, n: df.select(book, F.lit(n).alias("side"), F.col("unit_id").alias("id"), F.array_distinct(tokens(F.col("content"))).alias("t"))
    sets = materialize(side(gold, "g").unionByName(side(pred, "p")).where((F.size("t") > 0) & F.col(book).isNotNull()))
    is_gold = F.col("side") == "g"
    books = materialize(sets.groupBy(book).agg(F.count_if(is_gold).alias("golds"), F.count_if(~is_gold).alias("preds")).where("golds > 0 AND preds > 0"))
    cells = (books.agg(F.sum(F.col("golds") + F.col("preds"))).first()[0] or 0) // CELL + 1
    whole = (F.col("golds") <= CELL) & (F.col("preds") <= CELL)
    cuts = lambda n: F.ceil(F.col(n) / CELL)
    own = F.pmod(F.xxhash64("id"), F.when(is_gold, cuts("golds")).otherwise(cuts("preds")))
    met = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(is_gold, cuts("preds")).otherwise(cuts("golds")) - 1))
    placed = sets.join(books, book).withColumn("own", own).withColumn("met", met).select(
        F.when(whole, F.pmod(F.xxhash64(book), F.lit(cells)).cast("string")).otherwise(F.col(book).cast("string")).alias("home"),
        F.when(is_gold, F.col("own")).otherwise(F.col("met")).alias("row"), F.when(is_gold, F.col("met")).otherwise(F.col("own")).alias("column"), book, "side", "id", "t",
    )
    kind = {c: sets.schema[c].dataType.simpleString() for c in (book, "id")}
    schema = f"`{book}` {kind[book]}, gold_id {kind['id']}, pred_id {kind['id']}, sim double"
    return placed.groupBy("home", "row", "column").applyInArrow(lambda cell: _similar_in_cell(cell, book, threshold), schema)


def _similar_in_cell(cell: pa.Table, book: str, threshold: float) -> pa.Table:
    """The pairs above ``threshold`` among the golds and predictions of a cell, each with those of its book."""
    cell = cell.combine_chunks()
    cell = cell.take(pc.sort_indices(cell["side"])).combine_chunks()  # golds first
    golds = pc.sum(pc.equal(cell["side"], "g")).as_py() or 0
    preds = cell.num_rows - golds
    sets = cell["t"].combine_chunks()
    size = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(cell.num_rows), size)
    words = sets.flatten().dictionary_encode()
    books = cell[book].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # A token counts within its book. The tokens of a set are put in the order of rareness among the predictions.
    tok = np.unique(books[row] * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    kinds = int(tok.max(initial=-1)) + 1
    df = np.bincount(tok[start[golds]:], minlength=kinds)
    tok = tok[np.lexsort((tok, df[tok], row))]
    of_pred = tok[start[golds]:]
    postings = (row[start[golds]:] - golds)[np.argsort(of_pred, kind="stable")]
    at = np.concatenate([[0], np.cumsum(df)])
    # A pair above the threshold shares one of the first tokens. The rare ones beyond them are counted too, which leaves
    # fewer pairs; what these share of the other tokens is told by bits, one for each frequent token.
    tok, place = tok[: start[golds]], np.arange(start[golds]) - start[row[: start[golds]]]
    first = np.maximum(size[:golds] - np.ceil(threshold * size[:golds] - 1e-9).astype(np.int64) + 1, 1)
    counted = (place < first[row[: start[golds]]]) | (df[tok] * 32 <= preds)
    frequent = np.flatnonzero(df * 32 > preds)
    number = np.full(kinds, -1)
    number[frequent] = np.arange(len(frequent))
    m = np.bincount(row[: start[golds]][counted], minlength=golds)
    work = np.concatenate([[0], np.cumsum(np.bincount(row[: start[golds]][counted], weights=df[tok][counted], minlength=golds).astype(np.int64))])
    gold_size, pred_size = size[:golds], size[golds:]
    fewest = np.maximum(np.ceil(threshold * gold_size - 1e-9).astype(np.int64) - (gold_size - m), 1)

    def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The places from each ``begin`` on, ``length`` of them, one after the other."""
        return np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())

    def bits(rows: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
        """A row of 64-bit words for each of ``n`` sets."""
        flags = np.zeros((n, -(-max(len(frequent), 1) // 64) * 64), bool)
        flags[rows[numbers >= 0], numbers[numbers >= 0]] = True
        return np.packbits(flags, axis=1).view(np.uint64)

    gold_bits = bits(row[: start[golds]][~counted], number[tok[~counted]], golds)
    pred_bits = bits(row[start[golds]:] - golds, number[of_pred], preds)
    found = []
    g0 = 0
    while g0 < golds:
        g1 = max(g0 + 1, min(golds, g0 + AT_ONCE // max(preds, 1), int(np.searchsorted(work, work[g0] + AT_ONCE, "right")) - 1))
        t = tok[spread(start[g0:g1], m[g0:g1])]
        at_gold = np.repeat(np.arange(g1 - g0), m[g0:g1])
        common = np.bincount(np.repeat(at_gold, df[t]) * preds + postings[spread(at[t], df[t])], minlength=(g1 - g0) * preds)
        pair = np.flatnonzero(common.reshape(g1 - g0, preds) >= fewest[g0:g1, None])
        g, p, common = pair // max(preds, 1) + g0, pair % max(preds, 1), common[pair]
        x, y = gold_size[g], pred_size[p]
        likely = common + np.minimum(x - m[g], y - common) >= threshold / (1 + threshold) * (x + y) - 1e-9
        g, p, common = g[likely], p[likely], common[likely]
        for s in range(0, len(g), AT_ONCE // 64):
            gs, ps = g[s:s + AT_ONCE // 64], p[s:s + AT_ONCE // 64]
            both = common[s:s + AT_ONCE // 64] + np.bitwise_count(gold_bits[gs] & pred_bits[ps]).sum(axis=1, dtype=np.int64)
            sim = both / (gold_size[gs] + pred_size[ps] - both)
            found.append((gs[sim > threshold], ps[sim > threshold], sim[sim > threshold]))
        g0 = g1
    g, p, sim = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({book: cell[book].take(pa.array(g)), "gold_id": cell["id"].take(pa.array(g)), "pred_id": cell["id"].take(pa.array(p + golds)), "sim": pa.array(sim, pa.float64())})


def with_components(pairs: DataFrame) -> DataFrame:
    """``pairs`` (materialized) with ``part``: the smallest gold id of the connected component a pair is in.

    Labels spread from golds to their partners and back until none changes; a round is two grouped minima.
    """
    labels = materialize(pairs.select("gold_id", F.col("gold_id").alias("part")).distinct())
    while True:
        seen = pairs.select("gold_id", "pred_id").join(labels, "gold_id")
        lowest = seen.groupBy("pred_id").agg(F.min("part").alias("low"))
        spread = seen.join(lowest, "pred_id").groupBy("gold_id").agg(F.min("low").alias("part"), F.min("part").alias("was"))
        new = materialize(spread)
        labels = new.select("gold_id", "part")
        if new.where("part <> was").isEmpty():
            return pairs.join(labels, "gold_id")


def greedy(pairs: DataFrame, block: str) -> DataFrame:
    """One-to-one pairs per block: each gold in id order takes its best unused partner, the smallest id of equals.

    ``pairs``: (block, gold_id, pred_id, sim), above the threshold. Only pairs that hang together depend on
    each other's order, so each connected component is folded as a whole, many in a task, whatever the size of the block.
    """
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (block, "gold_id", "pred_id")}

    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        used, out, served = set(), [], None
        ordered = batch.sort_values([block, "gold_id", "sim", "pred_id"], ascending=[True, True, False, True])
        for b, gold, pred in zip(ordered[block], ordered["gold_id"], ordered["pred_id"]):
            if (b, gold) != served and (b, pred) not in used:
                used.add((b, pred))
                out.append((b, gold, pred))
                served = (b, gold)
        return pd.DataFrame(out, columns=[block, "gold_id", "pred_id"])

    written = materialize(pairs.select(block, "gold_id", "pred_id", "sim"))
    tasks = written.count() // 50_000 + 16
    parted = with_components(written).withColumn("task", F.pmod(F.xxhash64(block, "part"), F.lit(tasks)))
    return parted.groupBy("task").applyInPandas(fold, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def match_units(gold: DataFrame, pred: DataFrame, book: str = "_doc_id", threshold: float = 0.5) -> DataFrame:
    """(book, gold_id, pred_id, level): labels first, then the rest greedily by wording.

    Rows whose label matched, duplicates included, take no part in the second level.
    """
    level1 = match_labels_v2(gold, pred, book)
    done = level1.select(book, "key").distinct()
    left = lambda df: df.withColumn("key", F.coalesce(canonical_label(F.col("label")), F.concat(F.lit("#"), F.col("unit_id").cast("string")))).join(done, [book, "key"], "left_anti").drop("key")
    level2 = greedy(_similar_pairs(left(gold), left(pred), book, threshold), book)
    return level1.select(book, "gold_id", "pred_id", F.lit(1).alias("level")).unionByName(level2.select(book, "gold_id", "pred_id", F.lit(2).alias("level")))


def boundary(blocks: Column) -> Column:
    """struct(first, last) block, -1 for an empty list."""
    return F.struct(F.coalesce(F.array_min(blocks), F.lit(-1)).alias("first"), F.coalesce(F.array_max(blocks), F.lit(-1)).alias("last"))


def block_pairs(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of units with the same page and boundary; of duplicates the last counts. Adds gold_/pred_ ids and blocks."""
    def side(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(*keys, boundary(F.col("_source_blocks")).alias("edge"), F.col("unit_id").alias(f"{name}_id"), F.coalesce("_source_blocks", F.array().cast("array<int>")).alias(f"{name}_blocks"), F.col("env").alias(f"{name}_env"))
        return keep_first(keyed, [*keys, "edge"], [F.col(f"{name}_id").desc()])

    return side(gold, "gold").join(side(pred, "pred"), [*keys, "edge"])


def match_blocks(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(page, gold_id, pred_id): equal boundaries first, then per page greedily the largest block overlap above 0."""
    exact = block_pairs(gold, pred, keys).select(*keys, "gold_id", "pred_id")
    g = gold.join(exact.select(F.col("gold_id").alias("unit_id")), "unit_id", "left_anti").select(*keys, F.col("unit_id").alias("gold_id"), F.col("_source_blocks").alias("gb"))
    p = pred.join(exact.select(F.col("pred_id").alias("unit_id")), "unit_id", "left_anti").select(*keys, F.col("unit_id").alias("pred_id"), F.col("_source_blocks").alias("pb"))
    # A pair must share a block, so the join runs over (page, block), not over the page.
    shared = g.select(*keys, "gold_id", F.explode("gb").alias("block")).join(p.select(*keys, "pred_id", F.explode("pb").alias("block")), [*keys, "block"]).select(*keys, "gold_id", "pred_id").distinct()
    pairs = shared.join(g, [*keys, "gold_id"]).join(p, [*keys, "pred_id"]).withColumn("sim", jaccard(F.col("gb"), F.col("pb"))).where("sim > 0")
    page = F.concat_ws("\x1f", *keys)
    rest = greedy(pairs.select(page.alias("page"), "gold_id", "pred_id", "sim"), "page").select("gold_id", "pred_id")
    return exact.select("gold_id", "pred_id").unionByName(rest)
