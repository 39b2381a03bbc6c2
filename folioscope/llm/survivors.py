"""Best representative of each duplicate group.

Records of one unit make claims about its label and content. Each claim has a condition (what can be
seen of it: whole or cut, clean or noisy, which parts a label has) and an integrity from 0 to 1 (how
much of the longest claim it keeps). An iterative truth discovery starts from equal reliabilities and
alternates between the votes (per field the value class with the largest support, that is, the joint
reliability of the sources that claim it times its integrity) and the reliability of each source in
each condition (how often its claim survives), until the reliabilities settle. No order of the
conditions is laid down: which are to be trusted comes out of the iteration. Among the members that
carry the surviving value, integrity, trust rank, time and id decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.labels import canonical_number, parse_kind
from folioscope.llm import lexicon, scans
from folioscope.llm.truncation import content_ends_in_formula, content_final, label_broken
from folioscope.session import materialize, spread
from folioscope.vocab import BLANKS, KINDS

_LABEL_AHEAD = r"^\s*(?i:definition|theorem|lemma|proposition|corollary|example|remark|exercise|def|thm|lem|prop|cor|exmp|rem|exerc)\.?\s*(?:\d+(?:\.\d+)*\.?\s*(?:\([^()]*\)\s*)?|(?=[A-Z]))"
_MARKUP = r"</?[A-Za-z][^<>]*>|&#?\w+;|\[\[[^\]]*\]\]|\{\{[^}]*\}\}|\\(?:begin|end|label|ref|emph|textbf)\{[^}]*\}|\\[A-Za-z]+"


def _wording(content: Column) -> Column:
    """The letters and digits of a content without its label, for comparing wordings."""
    bare = F.regexp_replace(F.regexp_replace(content, _LABEL_AHEAD, ""), _MARKUP, "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"[-‐­¬]\s*\n\s*", ""), r"[^\p{L}\p{N}�]+", ""))


def members(units: DataFrame) -> DataFrame:
    """The records of units that have two or more, with ``group_id`` (the smallest unit id).

    A unit is a place of a book: (_doc_id, unit_index). Records without either stand alone. A unit id
    that occurs twice counts once (the row extracted last).
    """
    base = units.select("unit_id", "_doc_id", "unit_index", "label", "content", "number_components", "method", "extracted_at").where("_doc_id IS NOT NULL AND unit_index IS NOT NULL AND unit_id IS NOT NULL")
    # Counts and smallest ids are combined before the shuffle; texts move only for the groups found.
    groups = base.groupBy("_doc_id", "unit_index").agg(F.min("unit_id").alias("group_id"), F.max("unit_id").alias("last_id")).where("group_id < last_id").drop("last_id")
    rows = base.join(groups, ["_doc_id", "unit_index"])
    latest = Window.partitionBy("group_id", "unit_id").orderBy(F.desc_nulls_last("extracted_at"), F.desc_nulls_last(F.length("content")), F.desc_nulls_last("label"))
    return rows.withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn", "unit_index")


def _label_claims(rows: DataFrame) -> DataFrame:
    label = F.trim(F.regexp_replace(F.coalesce("label", F.lit("")), rf"{BLANKS}+", " "))
    word = F.lower(F.regexp_extract(label, r"^(\p{L}+)", 1))
    broken = label_broken(label, F.col("number_components"), F.lit(None).cast("int"))
    number = canonical_number(label)
    wanted = F.greatest(F.coalesce(F.size("number_components"), F.lit(0)), F.lit(0))
    kind_whole = word.isin(*KINDS)
    have = F.when(number.isNotNull(), F.size(F.split(number, r"\."))).otherwise(0)
    number_kept = F.when(number.isNotNull() & (wanted == 0), 1.0).when(wanted == 0, kind_whole.cast("double")).otherwise(F.least(F.lit(1.0), have / wanted))
    name = F.regexp_extract(label, r"\(([^()]+)\)", 1)
    kept = (number_kept * 4 + kind_whole.cast("int") * 2 + (name != "").cast("int")) / 7 * F.when(broken, 0.7).otherwise(1.0)
    condition = F.concat_ws("", F.when(number_kept >= 1, "number "), F.when(kind_whole, "kind "), F.when(name != "", "name "), F.when(broken, "broken"))
    value = F.concat_ws("|", F.coalesce(parse_kind(label), word), F.coalesce(number, F.lit("")), F.lower(name))
    integrity = F.when(label == "", 0.0).otherwise(F.coalesce(kept, F.lit(0.0)))
    return rows.select("group_id", "unit_id", "method", F.lit("label").alias("field"), F.when(label == "", "blank").otherwise(condition).alias("condition"), integrity.alias("integrity"), F.xxhash64(value).alias("value"))


def _content_claims(rows: DataFrame, noisy: DataFrame) -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    cut = ~(content_final(text) | content_ends_in_formula(text))
    words = _wording(text)
    rated = rows.select("group_id", "unit_id", "method", F.when(~text.rlike(r"\S"), 0).otherwise(F.length(words)).alias("size"), cut.alias("cut"), F.xxhash64(words).alias("value")).join(noisy, "unit_id", "left")
    rated = rated.join(rated.groupBy("group_id").agg(F.max("size").alias("longest")), "group_id")
    noise = F.coalesce("noise", F.lit(0))
    # Lost characters and a reading of two letters for one change a wording's size by the odd letter only.
    full = F.col("size") >= F.col("longest") - F.greatest(F.lit(2), noise * 2)
    kept = F.when(full, 1.0).otherwise(F.col("size") / F.col("longest")) * F.when(F.col("cut"), 0.7).otherwise(1.0) / (1 + 0.05 * noise)
    blank = F.col("size") == 0
    condition = F.when(blank, "blank").otherwise(F.concat_ws(" ", F.when(F.col("cut"), "cut").when(full, "whole").otherwise("part"), F.when(noise > 0, "noisy").otherwise("clean")))
    return rated.select("group_id", "unit_id", "method", F.lit("content").alias("field"), condition.alias("condition"), F.when(blank, 0.0).otherwise(kept).alias("integrity"), "value")


def noisy_contents(units: DataFrame, rows: DataFrame) -> DataFrame:
    """(unit_id, noise): how many signs of scan noise each content of ``rows`` holds; lexicon and line model from all units."""
    as_texts = lambda df: df.select(F.lit("unit").alias("kind"), F.col("unit_id").alias("id"), F.lit(-1).alias("block_id"), F.col("content").alias("text"), F.lit(scans.UNKNOWN).alias("place")).where(F.col("text").rlike(r"\S"))
    every, texts = spread(as_texts(units)), as_texts(rows)
    signs = scans.noise_signs(texts, lexicon.Words(every), scans.learn_lines(every)).select("id")
    lost = texts.where(F.col("text").contains(lexicon.LOST)).select("id")
    return signs.unionByName(lost).groupBy(F.col("id").alias("unit_id")).agg(F.count(F.lit(1)).alias("noise"))


class Reliability:
    """How far each source's claims in each condition are to be trusted, and whether the iteration settled."""

    def __init__(self) -> None:
        self.weights: dict[tuple, float] = {}
        self.rounds, self.moved = 0, 1.0
        self.converged = False

    def learn(self, shares: list, tolerance: float, own: float = 50.0, prior: float = 4.0) -> None:
        """New weights from rows (field, condition, method, kept, n): a source's share of surviving claims in a
        condition, drawn towards that of all sources where it made few (``own`` claims of theirs are added)."""
        whole: dict[tuple, list[float]] = {}
        for r in shares:
            entry = whole.setdefault((r["field"], r["condition"]), [0.0, 0.0])
            entry[0] += r["kept"]
            entry[1] += r["n"]
        mean = {key: (k + prior / 2) / (n + prior) for key, (k, n) in whole.items()}
        new = {(r["field"], r["condition"], r["method"]): (r["kept"] + own * mean[r["field"], r["condition"]]) / (r["n"] + own) for r in shares}
        self.moved = max((abs(w - self.weights.get(key, 0.5)) for key, w in new.items()), default=0.0)
        self.weights, self.rounds = new, self.rounds + 1
        self.converged = self.moved <= tolerance


def discover_truth(votes: DataFrame, rounds: int = 30, tolerance: float = 1e-3) -> tuple[DataFrame, Reliability]:
    """The surviving value class per (group_id, field), and the reliabilities.

    ``votes``: (group_id, field, value, method, condition, integrity, standing), materialized; one row per
    source, value and condition, so copies by one source are one voice. ``standing`` decides between equal
    supports. Only the reliabilities, one per source, field and condition (a closed list), reach the driver.
    ``rounds`` = 0 gives the votes of equal sources.
    """
    spark = votes.sparkSession
    found = Reliability()
    while True:
        table = spark.createDataFrame([(f, c, m, float(w)) for (f, c, m), w in found.weights.items()], "field string, condition string, source string, weight double")
        # As many rows as sources times conditions: a closed list.
        same = (F.col("field") == F.col("f")) & (F.col("condition") == F.col("c")) & F.col("method").eqNullSafe(F.col("source"))
        weighed = votes.join(F.broadcast(table.withColumnsRenamed({"field": "f", "condition": "c"})), same, "left")
        voice = F.log1p(-F.least(F.coalesce("weight", F.lit(0.5)), F.lit(0.999)))
        support = weighed.groupBy("group_id", "field", "value").agg(((1 - F.exp(F.sum(voice))) * F.max("integrity")).alias("support"), F.max("standing").alias("standing"))
        truth = support.groupBy("group_id", "field").agg(F.max_by("value", F.struct(F.round("support", 9), "standing")).alias("truth"))
        if found.converged or found.rounds >= rounds:
            return truth, found
        judged = votes.where("integrity > 0").join(truth, ["group_id", "field"])
        kept = F.sum((F.col("value") == F.col("truth")).cast("int"))
        found.learn(judged.groupBy("field", "condition", "method").agg(kept.alias("kept"), F.count(F.lit(1)).alias("n")).collect(), tolerance)


def _claims(units: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, claims, votes), materialized."""
    rows = materialize(members(units))
    claims = _label_claims(rows).unionByName(_content_claims(rows, noisy_contents(units, rows)))
    # One row per method: as small as the list of methods.
    trust = methods.where("method IS NOT NULL").groupBy("method").agg(F.min("trust_rank").alias("trust_rank"))
    ranked = rows.select("unit_id", "method", "extracted_at").join(trust, "method", "left").drop("method")
    standing = F.struct(
        -F.coalesce("trust_rank", F.lit(1 << 30)).alias("trust"),
        F.coalesce(F.unix_micros("extracted_at"), F.lit(-(1 << 60))).alias("time"),
        -F.col("unit_id").alias("id"),
    )
    claims = materialize(claims.join(ranked.select("unit_id", standing.alias("standing")), "unit_id"))
    votes = materialize(claims.groupBy("group_id", "field", "value", "method", "condition").agg(F.max("integrity").alias("integrity"), F.max("standing").alias("standing")))
    return rows, claims, votes


def surviving(units: DataFrame, methods: DataFrame, rounds: int = 30) -> DataFrame:
    """(unit_id, group_id, label_from, content_from), a row per member of a group of two or more.

    Blank and NULL values lose to any other; where all are blank the tie rules decide. A method
    without trust rank comes last.
    """
    rows, claims, votes = _claims(units, methods)
    truth, _ = discover_truth(votes, rounds)
    best = claims.join(truth, ["group_id", "field"])
    order = F.struct((F.col("value") == F.col("truth")).cast("int"), F.round("integrity", 9), "standing")
    picked = best.groupBy("group_id").agg(
        F.max_by(F.when(F.col("field") == "label", F.col("unit_id")), F.when(F.col("field") == "label", order)).alias("label_from"),
        F.max_by(F.when(F.col("field") == "content", F.col("unit_id")), F.when(F.col("field") == "content", order)).alias("content_from"),
    )
    return rows.select("unit_id", "group_id").join(picked, "group_id").select("unit_id", "group_id", "label_from", "content_from")


def reliabilities(units: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, field, condition, reliability, rounds, converged): what the truth discovery made of the sources."""
    votes = _claims(units, methods)[2]
    found = discover_truth(votes)[1]
    rows = [(m, f, c, float(w), found.rounds, found.converged) for (f, c, m), w in found.weights.items()]
    return votes.sparkSession.createDataFrame(rows, "method string, field string, condition string, reliability double, rounds int, converged boolean")


def golden_records(units: DataFrame, methods: DataFrame) -> DataFrame:
    """(group_id, _doc_id, label, content): the one surviving record of every unit, lone units included."""
    chosen = materialize(surviving(units, methods))
    one = chosen.select("group_id", "label_from", "content_from").distinct()
    labels = units.select(F.col("unit_id").alias("label_from"), "_doc_id", "label")
    contents = units.select(F.col("unit_id").alias("content_from"), "content")
    built = one.join(labels, "label_from").join(contents, "content_from").select("group_id", "_doc_id", "label", "content").dropDuplicates(["group_id"])
    alone = units.join(chosen.select("unit_id"), "unit_id", "left_anti").select(F.col("unit_id").alias("group_id"), "_doc_id", "label", "content")
    return built.unionByName(alone)
