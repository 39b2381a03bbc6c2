"""Alignment of reference units with OCR pages."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.metrics import env_type
from folioscope.operators.segment import HEADING, is_proof_start
from folioscope.session import materialize


def locate_units(gold: DataFrame, blocks: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, unit_id, page_id, blocks, score): the page and blocks of each reference unit.

    Per page the first block that has the unit's kind word and number opens it; it runs to the next
    numbered start, proof or heading. The most similar page wins, the earliest of equals; score 0 never
    does. ``exact`` asks for the whole number (``1.1`` is then not in ``1.10``). Units without a label
    with a number are not located. Blocks are joined on (book, kind word, number): every run of digits and dots
    of a block stands for all its parts, as a number counts wherever it occurs in the text.
    """
    label = T.canonical_label(F.col("label"))
    plain = T.strip_latex(F.col("content"), lower=False, unwrap="textbf|emph|textit")
    g = materialize(gold.select(F.col("_doc_id").alias("doc_id"), "unit_id", F.split(label, " ")[0].alias("word"), F.split(label, " ")[1].alias("number"), T.compared(plain).alias("text")).where("number IS NOT NULL"))
    stops = is_proof_start(F.col("text")) | (F.col("block_type") == "heading") | (F.regexp_extract(T.strip(F.col("text")), HEADING, 2) != "")
    marked = materialize(blocks.select("doc_id", "page_id", "pos", "block_id", "text", stops.alias("stops")))
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\d.]+"), 0))
    parts = lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.transform(F.sequence(F.lit(1), F.length(r) - i + 1), lambda n: F.substr(r, i, n))))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)"), 1), lambda w: F.initcap(F.lower(w))))
    worded = marked.select("doc_id", "page_id", "pos", "text", F.explode(words).alias("word"), runs.alias("runs"))
    keyed = worded.select("doc_id", "page_id", "pos", "text", "word", F.explode(F.array_distinct(F.flatten(F.transform("runs", parts)))).alias("number"))
    if exact:
        keyed = keyed.where(F.regexp_like("text", F.concat(F.lit(r"(^|[^\d.])"), F.replace("number", F.lit("."), F.lit(r"\.")), F.lit(r"($|[^\d.]|\.(\D|$))"))))
    # Units of one kind word and number open a page at one place: places and their texts are looked up once, not per unit.
    key = ["doc_id", "word", "number"]
    opened = materialize(g.select(*key).distinct().join(keyed.drop("text"), key).groupBy(*key, "page_id").agg(F.min("pos").alias("first")))
    after = Window.partitionBy("doc_id", "page_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    ends = marked.withColumn("next_stop", F.min(F.when(F.col("stops"), F.col("pos"))).over(after)).select("doc_id", "page_id", F.col("pos").alias("first"), "next_stop")
    places = opened.select("doc_id", "page_id", "first").distinct().join(ends, ["doc_id", "page_id", "first"])
    body = places.join(marked, ["doc_id", "page_id"]).where((F.col("pos") >= F.col("first")) & (F.col("pos") < F.coalesce("next_stop", F.lit(2**31 - 1))))
    bodies = body.groupBy("doc_id", "page_id", "first").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "text"))).alias("b"))
    bodies = materialize(bodies.select("doc_id", "page_id", "first", F.transform("b", lambda x: x["block_id"]).alias("blocks"), T.compared(F.array_join(F.transform("b", lambda x: x["text"]), " ")).alias("text")))
    best = most_similar_pages(g, opened.join(bodies.drop("blocks"), ["doc_id", "page_id", "first"]), key)
    return best.join(bodies.drop("text"), ["doc_id", "page_id", "first"]).select("doc_id", "unit_id", "page_id", "blocks", "score")


#: Pairs of a unit and a page in a task of :func:`most_similar_pages`.
PAIRS = 500_000


def most_similar_pages(units: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """(doc_id, unit_id, page_id, first, score): of the pages with a unit's key the most similar one, the earliest of equals, none at 0.

    ``units``: (key, unit_id, text), ``pages``: (key, page_id, first, text). A key with many pairs is dealt by its units to
    several tasks, keys with few share one.
    """
    counts = units.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(pages.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), key)
    sizes = materialize(counts.select(*key, F.ceil(F.col("n") * F.col("m") / PAIRS).alias("cuts"), (F.col("n") + F.col("m")).alias("rows")))
    homes = (sizes.agg(F.sum("rows")).first()[0] or 0) // 20_000 + 1
    home = F.when(F.col("cuts") > 1, F.to_json(F.struct(*key))).otherwise(F.pmod(F.xxhash64(*key), F.lit(homes)).cast("string"))
    kind = {"unit_id": units.schema["unit_id"].dataType.simpleString(), "doc_id": units.schema["doc_id"].dataType.simpleString(), "page_id": pages.schema["page_id"].dataType.simpleString(), "first": pages.schema["first"].dataType.simpleString()}
    none = lambda c: F.lit(None).cast(kind[c]).alias(c)
    u = units.join(sizes, key).select(home.alias("home"), F.pmod(F.xxhash64("unit_id"), F.col("cuts")).alias("cut"), *key, "unit_id", none("page_id"), none("first"), "text")
    p = pages.join(sizes, key).select(home.alias("home"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("cut"), *key, none("unit_id"), "page_id", "first", "text")
    schema = f"doc_id {kind['doc_id']}, unit_id {kind['unit_id']}, page_id {kind['page_id']}, first {kind['first']}, score double"

    def compare(cell: pa.Table) -> pa.Table:
        groups: dict[tuple, tuple[list, list]] = {}
        rows = zip(*[cell[c].to_pylist() for c in (*key, "unit_id", "page_id", "first", "text")])
        for *k, unit, page, first, text in rows:
            of_units, of_pages = groups.setdefault(tuple(k), ([], []))
            of_units.append((unit, text)) if page is None else of_pages.append((page, first, text))
        out = []
        for k, (of_units, of_pages) in groups.items():
            of_pages.sort()
            for (unit, _), (score, at) in zip(of_units, most_similar([t for _, t in of_units], [t for *_, t in of_pages])):
                if score > 0:
                    out.append((k[0], unit, *of_pages[at][:2], score))
        columns = list(zip(*out)) or [[]] * 5
        like = [cell.schema.field(c).type for c in (key[0], "unit_id", "page_id", "first")] + [pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, like)], names=["doc_id", "unit_id", "page_id", "first", "score"])

    return u.unionByName(p).groupBy("home", "cut").applyInArrow(compare, schema)


def _letters(texts: list[str]) -> np.ndarray:
    """How often each letter is in each text (letters beyond ASCII share places): a row per place, a column per text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) & 127
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(codes.astype(np.int64) * len(texts) + owner, minlength=128 * len(texts)).reshape(128, -1).astype(np.uint16)


def _plain(text: str, mark: str) -> str | None:
    """``text`` with ``mark`` for the letters that ``difflib`` calls popular; None if there are none (as under 200 letters)."""
    if len(text) < 200:
        return None
    counts = Counter(text)
    popular = {ord(c): mark for c, n in counts.items() if n > len(text) // 100 + 1}
    return text.translate(popular) if popular else None


def reaching_ratio(a: str, b: str, plain: str | None, least: float) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``, or -1 as soon as it is sure to be below ``least``.

    The longest common runs are found by substring search. ``plain`` is :func:`_plain` of ``b`` with a mark that ``a`` doesn't
    have: runs are looked for without popular letters and then extended over them.
    """
    total = len(a) + len(b)
    if not total:
        return 1.0
    within = b if plain is None else plain
    matched, room = 0, min(len(a), len(b))
    todo = [(0, len(a), 0, len(b))]
    while todo:
        # What is matched and the shorter sides of what is left can't be exceeded.
        if 2.0 * (matched + room) / total < least:
            return -1.0
        alo, ahi, blo, bhi = todo.pop()
        room -= min(ahi - alo, bhi - blo)
        at, size = alo, 0
        for i in range(alo, ahi):
            if i + size >= ahi:
                break
            while i + size < ahi and within.find(a[i:i + size + 1], blo, bhi) >= 0:
                at, size = i, size + 1
        j = within.find(a[at:at + size], blo, bhi) if size else blo
        i, end = at, at + size
        if plain is not None:
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            while end < ahi and j + end - i < bhi and a[end] == b[j + end - i]:
                end += 1
        if end > i:
            matched += end - i
            for piece in ((alo, i, blo, j), (end, ahi, j + end - i, bhi)):
                if piece[0] < piece[1] and piece[2] < piece[3]:
                    todo.append(piece)
                    room += min(piece[1] - piece[0], piece[3] - piece[2])
    return 2.0 * matched / total


def most_similar(wanted: list[str], texts: list[str]) -> list[tuple[float, int]]:
    """For each wanted text the highest sequence ratio among ``texts`` and the first place that has it.

    Common letters bound the ratio from above, so that it is worked out only where the bound reaches the best one so far.
    """
    best = [(-1.0, 0)] * len(wanted)
    if not texts:
        return best
    have, want = _letters(texts), _letters(wanted)
    sizes = np.array([len(t) for t in texts])
    bounds = []
    used = set("".join(wanted))
    mark = next(c for c in map(chr, range(0x110000)) if c not in used)

    def look(i: int, at: int, plain: str | None) -> None:
        ratio = reaching_ratio(wanted[i], texts[at], plain, best[i][0])
        if (ratio, -at) > (best[i][0], -best[i][1]):
            best[i] = (ratio, at)

    later: dict[int, list[int]] = {}
    for i, text in enumerate(wanted):
        common = np.zeros(len(texts), np.uint16)
        for c in np.flatnonzero(want[:, i]):
            common += np.minimum(have[c], want[c, i])
        bound = np.where(sizes + len(text) > 0, 2.0 * common / np.maximum(sizes + len(text), 1), 1.0)
        top = np.argpartition(-bound, 15)[:16] if len(texts) > 16 else np.arange(len(texts))
        for at in top[np.argsort(-bound[top], kind="stable")].tolist():
            if bound[at] >= best[i][0]:
                look(i, at, _plain(texts[at], mark))
        left = np.flatnonzero(bound >= best[i][0])
        left = left[~np.isin(left, top)]
        bounds.append(dict(zip(left.tolist(), bound[left].tolist())))
        for at in left.tolist():
            later.setdefault(at, []).append(i)
    # A page is prepared once for all units left.
    for at, rest in later.items():
        rest = [i for i in rest if bounds[i][at] >= best[i][0]]
        plain = _plain(texts[at], mark) if rest else None
        for i in rest:
            look(i, at, plain)
    return best


def built_gold(units: DataFrame, blocks: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(block-form gold units, count of units not located per book) of annotated env-form units.

    The statement is the text of the located blocks, not the annotation's; formula blocks become formula
    spans; ids number a book's units in the order of their annotation (``unit_id``), located or not.
    """
    numbered = units.withColumn("seq", F.row_number().over(Window.partitionBy("_doc_id").orderBy("unit_id")) - 1)
    found = locate_units(units, blocks, exact).select(F.col("doc_id"), "unit_id", "page_id", "blocks")
    looked_up = found.select("doc_id", "unit_id", "page_id", F.posexplode("blocks").alias("i", "block_id")).join(blocks.select("doc_id", "page_id", "block_id", T.strip(F.col("text")).alias("text"), "block_type"), ["doc_id", "page_id", "block_id"])
    entry = F.struct("i", "block_id", "text", "block_type")
    put = looked_up.groupBy("doc_id", "unit_id", "page_id").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    spans = F.transform(F.filter("b", lambda x: x["block_type"] == "formula"), lambda x, i: F.struct(F.format_string("f_%s_%02d", F.col("page_id"), i + 1).alias("formula_id"), x["text"].alias("text"), x["block_id"].alias("source_block")))
    ids = F.transform("b", lambda x: x["block_id"])
    statement = F.array_join(F.transform("b", lambda x: x["text"]), " ")
    meta = numbered.select("unit_id", "seq", env_type(F.col("env")).alias("unit_type"), T.strip(F.col("label")).alias("title"))
    gold = put.join(meta, "unit_id").select("doc_id", "page_id", F.format_string("gold_%s_%04d", "doc_id", "seq").alias("gold_id"), "unit_type", "title", statement.alias("statement_text"), spans.alias("formula_spans"), ids.alias("source_blocks"), ids.alias("reading_order"))
    missing = units.select(F.col("_doc_id").alias("doc_id"), "unit_id").join(found.select("unit_id"), "unit_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("not_located"))
    return gold, missing
