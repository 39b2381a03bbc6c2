"""Queries of matching and evaluation as a whole, with the SQL that must give the same rows.

Gold units are those delivered by the method ``gold``, predictions by ``ours`` unless a method is named. The SQL folds greedy
choices in a recursive query and counts edits in characters by giving every other character a capital of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import scores as S
from folioscope.functions import text as T
from folioscope.operators import evaluate, match, metrics, stats
from folioscope.plans import core_queries as C
from folioscope.plans import pipelines
from folioscope.session import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- SQL pieces -----------------------------------------------------------------------------------

_CAPITALS = "('ABCDEFGHIJKLMNOPQRSTUVWXYZ' || array_to_string(list_transform(range(14, 32), lambda i: chr(i::INTEGER)), '') || array_to_string(list_transform(range(1, 9), lambda i: chr(i::INTEGER)), ''))"


def _edit(a: str, b: str, first: int | None = None) -> str:
    """Edit distance over the longer length, of texts in small letters."""
    a, b = (f"left({x}, {first})" if first else x for x in (a, b))
    odd = f"array_to_string(list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]')), '')"
    plain = lambda x: f"translate({x}, {odd}, left({_CAPITALS}, length({odd})))"
    return f"(levenshtein({plain(a)}, {plain(b)}) / greatest(length({a}), length({b}), 1))"


def _delimiters(text: str) -> str:
    """Closers still due; a leading ``!`` once a closer came that was not due."""
    return f"list_reduce(regexp_extract_all({text}, '[()\\[\\]{{}}]'), lambda s, c: CASE WHEN left(s, 1) = '!' THEN s WHEN c IN ('(', '[', '{{') THEN translate(c, '([{{', ')]}}') || s WHEN left(s, 1) = c THEN substr(s, 2) ELSE '!' || s END, '')"


_FORMULA = r"(?s)\$\$.*?\$\$|\$[^$]+\$|\\\(.*?\\\)|\\\[.*?\\\]|\\begin\{(?:equation|align|gather|eqnarray)\*?\}.*?\\end\{(?:equation|align|gather|eqnarray)\*?\}"
_SET = lambda x: f"list_distinct({C._TOK(x)})"
_RECALL = lambda wanted, got: f"(CASE WHEN len({wanted}) = 0 THEN 1.0 ELSE len(list_intersect({wanted}, {got})) / len({wanted}) END)"
_SPANS = "list_transform(coalesce(p._formula_spans, []), lambda s: s.text)"
_V1_TEXT = C._V1TXT
_V1_STATE = _delimiters(_V1_TEXT)
_V1_SYMBOL = C._CLAMP("1::DOUBLE" + C._D(f"contains({_V1_TEXT}, chr(65533))", 0.35) + C._D(f"left({_V1_STATE}, 1) = '!'", 0.35) + C._D(f"ltrim({_V1_STATE}, '!') <> ''", 0.35) + C._D(f"length({C._STRIP(_V1_TEXT)}) < 10", 0.15))
_V1_PARSE = f"CASE WHEN coalesce(label, '') = '' OR coalesce(env, '') = '' OR {C._CS} = '' THEN 0::DOUBLE ELSE 1::DOUBLE END"
_V1_RETRIEVAL = C._CLAMP("1::DOUBLE" + C._D("coalesce(label, '') = ''", .2) + C._D("coalesce(env, '') = ''", .2) + C._D(f"coalesce(env, '') NOT IN {C._V1ENV}", .2) + C._D(f"{C._CS} = ''", .2) + C._D("coalesce(_doc_id, '') = ''", .1) + C._D("coalesce(_page_id, '') = ''", .1))


def _greedy(pairs: str, name: str) -> str:
    """Common table expressions ``name``(gold_id, pred_id): each gold in id order takes its best unused partner of ``pairs``."""
    return f"""{name}_c AS (SELECT gold_id, row_number() OVER (ORDER BY gold_id) AS i, list(pred_id ORDER BY sim DESC, pred_id) AS cand FROM {pairs} GROUP BY gold_id),
{name}_w(i, used, gold_id, pred_id) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL SELECT i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, gold_id, pick
 FROM (SELECT c.i, w.used, c.gold_id, list_filter(c.cand, lambda x: NOT list_contains(w.used, x))[1] AS pick FROM {name}_w w JOIN {name}_c c ON c.i = w.i + 1)),
{name} AS (SELECT gold_id, pred_id FROM {name}_w WHERE pred_id IS NOT NULL)"""


def _matched(pred: str = "ours") -> str:
    """CTEs ``pairs`` (level 1), ``fuzzy`` (level 2) and ``mt``(_doc_id, gold_id, pred_id, level)."""
    labels = C._LABELS.replace("method = 'ours'", f"method = '{pred}'")
    key = f"coalesce({C._CANON('label')}, '#' || unit_id)"
    rest = lambda side: f"SELECT _doc_id, unit_id, {_SET(chr(99) + 'oalesce(content, ' + chr(39) * 2 + ')')} AS t FROM {side} s WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs._doc_id = s._doc_id AND pairs.key = {key})"
    return f"""{labels}, gr AS ({rest('gold')}), prr AS ({rest('pred')}),
cand AS (SELECT gr._doc_id, gr.unit_id AS gold_id, prr.unit_id AS pred_id, len(list_intersect(gr.t, prr.t)) / len(list_distinct(gr.t || prr.t)) AS sim FROM gr JOIN prr ON gr._doc_id = prr._doc_id WHERE len(gr.t) > 0 AND len(prr.t) > 0 AND len(list_intersect(gr.t, prr.t)) / len(list_distinct(gr.t || prr.t)) > 0.5),
{_greedy('cand', 'fuzzy')},
mt AS (SELECT _doc_id, gold_id, pred_id, 1 AS level FROM pairs UNION ALL SELECT g._doc_id, gold_id, pred_id, 2 FROM fuzzy JOIN units g ON g.unit_id = fuzzy.gold_id)"""


def _scored(pairs: str, family: str, first: int | None = 500) -> str:
    """CTEs ending in ``sc``: the pair scores of ``pairs``(_doc_id, gold_id, pred_id); ``first`` characters count for the edit distance."""
    if family == "v2":
        parse, symbol, retrieval = C._P2, C._S2, C._R2
        same = "(g.env IS NOT DISTINCT FROM p.env)::INT"
        wanted = f"list_filter(list_transform(regexp_extract_all(coalesce(g.content, ''), '{_FORMULA}'), lambda f: {_SET('f')}), lambda t: len(t) > 0)"
        have = _SET(C._OCR("p.content"))
        formula = f"CASE WHEN len({wanted}) = 0 THEN 1.0 ELSE len(list_filter({wanted}, lambda t: len(list_intersect(t, {have})) / len(t) > 0.5)) / len({wanted}) END"
    else:
        parse, symbol, retrieval = _V1_PARSE, _V1_SYMBOL, _V1_RETRIEVAL
        kind = lambda a: C._TYPE.replace("CASE env", f"CASE {a}.env")
        same = f"(({kind('g')}) = ({kind('p')}))::INT"
        have = _SET(C._latex_sql("g.content"))
        hit = f"len(list_filter({_SPANS}, lambda s: {_RECALL(_SET(C._OCR('s')), have)} > 0.3))"
        formula = f"CASE WHEN len({_SPANS}) = 0 THEN CASE WHEN regexp_matches(coalesce(g.content, ''), '\\$\\$|\\\\begin\\{{(equation|align|gather)') THEN 0.0 ELSE 1.0 END ELSE {hit} / len({_SPANS}) END"
    own = f"SELECT unit_id, {parse} AS parse, {symbol} AS symbol, {retrieval} AS retrieval FROM units"
    gt, pt = C._latex_sql("g.content"), C._OCR("p.content")
    begun = lambda x: f"left({x}, {first})" if first else x
    return f"""own AS ({own}), j AS (SELECT x._doc_id, gold_id, pred_id, g.env AS gold_env, {same} AS type_ok, {gt} AS gt, {pt} AS pt, {formula} AS formula, own.parse, own.symbol, own.retrieval FROM {pairs} x JOIN units g ON g.unit_id = gold_id JOIN units p ON p.unit_id = pred_id JOIN own ON own.unit_id = pred_id),
sc AS (SELECT _doc_id, gold_id, pred_id, gold_env, type_ok, {_RECALL(_SET('gt'), _SET('pt'))} AS completeness, CASE WHEN {begun('gt')} = {begun('pt')} THEN 0.0 ELSE {_edit('gt', 'pt', first)} END AS edit, formula, parse, symbol, retrieval, (parse + symbol + retrieval) / 3 AS ready FROM j)"""


_MEANS = "avg(type_ok) AS type_accuracy, " + ", ".join(f"avg({m}) AS {m}" for m in metrics.SCORES)
_OR_NONE = "coalesce(type_accuracy, 0) AS type_accuracy, " + ", ".join(f"coalesce({m}, {1 if m == 'edit' else 0}) AS {m}" for m in metrics.SCORES)
_PRF = """CASE WHEN pred > 0 THEN matched / pred ELSE 0 END AS precision, CASE WHEN gold > 0 THEN matched / gold ELSE 0 END AS recall"""
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"


def _evaluation(ctes: str, pairs: str, family: str, first: int | None = 500) -> str:
    if family == "v1":
        gold = "SELECT _doc_id, count(*) AS gold FROM gk GROUP BY 1"
        pred = "SELECT _doc_id, count(*) AS pred FROM pk GROUP BY 1"
    else:
        gold, pred = "SELECT _doc_id, count(*) AS gold FROM gold GROUP BY 1", "SELECT _doc_id, count(*) AS pred FROM pred GROUP BY 1"
    return f"""WITH RECURSIVE {ctes}, {_scored(pairs, family, first)}, mean AS (SELECT _doc_id, {_MEANS} FROM sc GROUP BY 1), gn AS ({gold}), pn AS ({pred}), mn AS (SELECT _doc_id, count(*) AS matched FROM {pairs} GROUP BY 1),
books AS (SELECT DISTINCT _doc_id FROM (SELECT _doc_id FROM gold UNION ALL SELECT _doc_id FROM pred)),
n AS (SELECT _doc_id, coalesce(matched, 0) AS matched, coalesce(gold, 0) AS gold, coalesce(pred, 0) AS pred FROM books LEFT JOIN mn USING (_doc_id) LEFT JOIN gn USING (_doc_id) LEFT JOIN pn USING (_doc_id)),
r AS (SELECT *, {_PRF} FROM n) SELECT r.*, {_F1}, {_OR_NONE} FROM r LEFT JOIN mean USING (_doc_id)"""


# --- label and wording ----------------------------------------------------------------------------


@query(f"SELECT unit_id, {_V1_SYMBOL} AS symbol FROM units")
def symbol_score_v1(spark, d):
    spans = F.transform("_formula_spans", lambda s: s["text"])
    return C._units(spark, d).select("unit_id", S.v1_symbol(F.col("content"), spans).alias("symbol"))


@query(f"WITH RECURSIVE {_matched()} SELECT * FROM mt")
def fuzzy_greedy_match(spark, d):
    return match.match_units(*C._sides(spark, d))


@query(_evaluation(C._LABELS, "pairs", "v1"))
def evaluate_v1(spark, d):
    return pipelines.evaluate(*C._sides(spark, d), family="v1")


@query(_evaluation(_matched(), "mt", "v2", None))
def evaluate_v2(spark, d):
    return pipelines.evaluate(*C._sides(spark, d), family="v2")


def _label_pairs(spark, d):
    g, p = C._sides(spark, d)
    pairs = match.match_labels_v2(g, p).select("_doc_id", "gold_id", "pred_id")
    return metrics.pair_scores(metrics.with_units(pairs, g, p))


@query(f"WITH {C._LABELS}, {_scored('pairs', 'v2')} SELECT _doc_id, count(*) AS matched, {_MEANS} FROM sc GROUP BY 1")
def content_scores(spark, d):
    return metrics.summary(_label_pairs(spark, d), ["_doc_id"])


@query(f"WITH {C._LABELS}, {_scored('pairs', 'v1')} SELECT gold_id, pred_id, type_ok, completeness, edit, formula, parse, symbol, retrieval, ready FROM sc")
def pair_scores_v1(spark, d):
    g, p = C._sides(spark, d)
    pairs = match.match_labels_v1(g, p).where("gold_id IS NOT NULL AND pred_id IS NOT NULL").select("_doc_id", "gold_id", "pred_id")
    return metrics.pair_scores(metrics.with_units(pairs, g, p), "v1").drop("_doc_id", "gold_env")


@query(f"WITH {C._LABELS}, {_scored('pairs', 'v2')} SELECT gold_env, count(*) AS matched, {_MEANS} FROM sc GROUP BY 1")
def by_type_breakdown(spark, d):
    return metrics.summary(_label_pairs(spark, d), ["gold_env"])


_GROUP = "CASE WHEN type = 'definition' THEN 'definition' WHEN type IN ('theorem', 'lemma', 'proposition', 'corollary') THEN 'theorem_group' WHEN type = 'example' THEN 'example' ELSE 'other' END"


@query(f"WITH {C._LABELS}, {_scored('pairs', 'v2')}, t AS (SELECT *, {C._TYPE.replace('CASE env', 'CASE gold_env')} AS type FROM sc) SELECT {_GROUP} AS type_group, count(*) AS matched, {_MEANS} FROM t GROUP BY 1")
def by_type_group(spark, d):
    return metrics.summary(_label_pairs(spark, d).withColumn("type_group", metrics.type_group(F.col("gold_env"))), ["type_group"])


_MACRO = ", ".join(f"avg({m}) AS {m}_mean, coalesce(stddev_samp({m}), 0) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in ("type_accuracy", *metrics.SCORES))


@query(f"WITH {C._LABELS}, {_scored('pairs', 'v2')}, b AS (SELECT _doc_id, {_MEANS} FROM sc GROUP BY 1) SELECT count(*) AS chapters, {_MACRO} FROM b")
def macro_mean_std(spark, d):
    return metrics.macro(content_scores(spark, d), [], ["type_accuracy", *metrics.SCORES])


@query(f"""WITH RECURSIVE {_matched()}, {_scored('mt', 'v2')}, n AS (SELECT (SELECT count(*) FROM mt) AS matched, (SELECT count(*) FROM gold) AS gold, (SELECT count(*) FROM pred) AS pred), r AS (SELECT *, {_PRF} FROM n)
SELECT r.*, {_F1}, m.* FROM r, (SELECT {_MEANS} FROM sc) m""")
def micro_match_then_pool(spark, d):
    return pipelines.evaluate_pooled(*C._sides(spark, d))


@query(f"""WITH {C._LABELS}, {_scored('pairs', 'v2')}, v AS (SELECT row_number() OVER (ORDER BY ready) - 1 AS i, ready AS v FROM (SELECT _doc_id, avg(ready) AS ready FROM sc GROUP BY 1)), n AS (SELECT count(*) AS n FROM v),
x AS (SELECT b, d, (((b * 7919 + d * 104729 + 42 * 1299709) % 2147483647) * 48271) % 2147483647 AS x FROM range(10000) AS r(b), range((SELECT n FROM n)) AS s(d)), y AS (SELECT b, ((x * 48271) % 2147483647) % (SELECT n FROM n) AS i FROM x),
m AS (SELECT b, avg(v) AS m FROM y JOIN v USING (i) GROUP BY 1), k AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM m) SELECT avg(m) AS mean, max(m) FILTER (WHERE r = 250) AS low, max(m) FILTER (WHERE r = 9750) AS high FROM k""")
def bootstrap_interval(spark, d):
    return metrics.bootstrap(materialize(content_scores(spark, d).select("_doc_id", "ready")), "ready")


# --- block form -----------------------------------------------------------------------------------

_OVER = "len(list_intersect(list_distinct(g._source_blocks), list_distinct(p._source_blocks))) / len(list_distinct(g._source_blocks || p._source_blocks))"
_BLOCKS = f"""{C._EDGE}, exact AS (SELECT gold_id, pred_id FROM ge JOIN pe USING (_doc_id, _page_id, a, b)),
near AS (SELECT g.unit_id AS gold_id, p.unit_id AS pred_id, {_OVER} AS sim FROM gold g JOIN pred p ON g._doc_id = p._doc_id AND g._page_id = p._page_id WHERE g.unit_id NOT IN (SELECT gold_id FROM exact) AND p.unit_id NOT IN (SELECT pred_id FROM exact) AND len(list_intersect(g._source_blocks, p._source_blocks)) > 0),
{_greedy('near', 'greedy')}, bp AS (SELECT gold_id, pred_id FROM exact UNION ALL SELECT gold_id, pred_id FROM greedy)"""


@query(f"WITH RECURSIVE {_BLOCKS} SELECT * FROM bp")
def block_overlap_match(spark, d):
    return match.match_blocks(*C._sides(spark, d), ["_doc_id", "_page_id"])


_BLK_TEXT = C._BT
_BLK_STATE = _delimiters(_BLK_TEXT)
_NOISY = f"contains({_BLK_TEXT}, chr(65533)) OR regexp_matches({_BLK_TEXT}, '(^|[^0-9A-Za-z_])[Il1]{{5,}}([^0-9A-Za-z_]|$)') OR (regexp_matches({_BLK_TEXT}, '[^\\x00-\\x7F]{{4,}}') AND NOT contains({_BLK_TEXT}, 'σ') AND NOT contains({_BLK_TEXT}, 'π'))"
_NO_ID = "coalesce(_doc_id,'')='' OR coalesce(_page_id,'')=''"
_NO_BLOCKS = "coalesce(len(_source_blocks),0)=0"
_BLK_SCORES = f"""SELECT unit_id, CASE WHEN {_NO_ID} OR {C._CS} = '' OR {_NO_BLOCKS} THEN 0::DOUBLE ELSE 1::DOUBLE END AS parse,
CASE WHEN {_BLK_TEXT} = '' THEN 0::DOUBLE ELSE {C._CLAMP("1::DOUBLE" + C._D(f"{_BLK_STATE} <> ''", .35) + C._D(_NOISY, .35) + C._D(f"length({C._CS}) < 10", .15) + C._D("len(_source_blocks) <> len(list_distinct(_source_blocks))", .15))} END AS symbol,
{C._CLAMP("1::DOUBLE" + C._D("coalesce(_doc_id,'')=''", .2) + C._D("coalesce(_page_id,'')=''", .2) + C._D(_NO_BLOCKS, .2) + C._D(_NO_BLOCKS, .1) + C._D(f"{C._CS} = ''", .1))} AS retrieval FROM units"""
_DOWN = f"""bs AS ({_BLK_SCORES}), dn AS (SELECT g._doc_id AS doc_id, count(bp.pred_id) AS matched_over_all_gold, avg(coalesce(parse, 0)) AS structured_parse_success, avg(coalesce(symbol, 0)) AS symbol_stability, avg(coalesce(retrieval, 0)) AS retrieval_compatibility,
 avg(coalesce((parse + symbol + retrieval) / 3, 0)) AS formalization_readiness FROM gold g LEFT JOIN bp ON bp.gold_id = g.unit_id LEFT JOIN bs ON bs.unit_id = bp.pred_id GROUP BY 1)"""


@query(f"WITH RECURSIVE {_BLOCKS}, {_DOWN} SELECT * FROM dn")
def downstream_over_all_gold(spark, d):
    g, p = C._sides(spark, d)
    pairs = match.match_blocks(g, p, ["_doc_id", "_page_id"])
    gold = evaluate.block_form(g)
    return evaluate.downstream(gold, evaluate._paired(pairs, gold, evaluate.block_form(p)))


_STATEMENT = lambda c: f"lower({C._COLLAPSE(c)})"
_SYMBOLS = lambda c: f"regexp_extract_all({c}, '[a-zA-Z0-9_]+|[^\\s]')"
_SPAN_SET = lambda a: f"list_sort(list_distinct(list_filter(list_transform(coalesce({a}._formula_spans, []), lambda s: s.source_block), lambda b: b IS NOT NULL)))"
_MULTI = "list_sum(list_transform(list_distinct(gk), lambda t: least(len(list_filter(gk, lambda x: x = t)), len(list_filter(pk, lambda x: x = t)))))"
_TYPE_OF = lambda c: C._TYPE.replace("CASE env", f"CASE {c}")


@query(f"""WITH RECURSIVE {_BLOCKS}, {_DOWN},
e AS (SELECT coalesce(ge._doc_id, pe._doc_id) AS doc_id, gold_id, pred_id, ge, pe, gb, pb FROM ge FULL JOIN pe ON ge._doc_id = pe._doc_id AND ge._page_id = pe._page_id AND ge.a = pe.a AND ge.b = pe.b),
s AS (SELECT doc_id, count(gold_id) AS gold, count(pred_id) AS pred, count(*) FILTER (WHERE gold_id IS NOT NULL AND pred_id IS NOT NULL) AS matched, avg((({_TYPE_OF('ge')}) = ({_TYPE_OF('pe')}))::INT) FILTER (WHERE gold_id IS NOT NULL AND pred_id IS NOT NULL) AS ut,
 avg(CASE WHEN len(coalesce(gb, []) || coalesce(pb, [])) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(gb), list_distinct(pb))) / len(list_distinct(gb || pb)) END) FILTER (WHERE gold_id IS NOT NULL AND pred_id IS NOT NULL) AS ba FROM e GROUP BY 1),
st AS (SELECT doc_id, ut, ba, {_PRF} FROM s),
t AS (SELECT g._doc_id AS doc_id, {_SPAN_SET('g')} = {_SPAN_SET('p')} AS same, {_STATEMENT('g.content')} AS gt, {_STATEMENT('p.content')} AS pt FROM bp JOIN units g ON g.unit_id = gold_id JOIN units p ON p.unit_id = pred_id),
u AS (SELECT *, {_SYMBOLS('gt')} AS gk, {_SYMBOLS('pt')} AS pk FROM t),
i AS (SELECT doc_id, count(*) AS n, avg(same::INT) AS fa, avg(CASE WHEN len(gk) = 0 THEN 1.0 ELSE {_MULTI} / len(gk) END) AS co, avg(CASE WHEN gt = pt THEN 0.0 ELSE {_edit('gt', 'pt')} END) AS ed FROM u GROUP BY 1)
SELECT doc_id, precision AS boundary_precision, recall AS boundary_recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS boundary_f1, coalesce(ut, 0) AS unit_type_accuracy, coalesce(ba, 0) AS block_assignment_accuracy,
 coalesce(n, 0) AS matched_unit_count, coalesce(fa, 0) AS formula_attachment_accuracy, coalesce(co, 0) AS statement_completeness, coalesce(ed, 1) AS normalized_edit_distance,
 coalesce(structured_parse_success, 0) AS structured_parse_success, coalesce(symbol_stability, 0) AS symbol_stability, coalesce(retrieval_compatibility, 0) AS retrieval_compatibility, coalesce(formalization_readiness, 0) AS formalization_readiness
FROM st LEFT JOIN i USING (doc_id) LEFT JOIN dn USING (doc_id)""")
def evaluate_blocks(spark, d):
    g, p = C._sides(spark, d)
    return evaluate.evaluate_blocks(g, p, materialize(match.match_blocks(g, p, ["_doc_id", "_page_id"])))


# --- annotators, changes, errors ------------------------------------------------------------------

_F1_SETS = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len(list_intersect({a}, {b})) = 0 THEN 0.0 ELSE 2 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
_FTOK = lambda c: f"list_distinct(flatten(list_transform(regexp_extract_all(coalesce({c}, ''), '{_FORMULA}'), lambda f: {C._TOK('f')})))"


@query(f"""WITH RECURSIVE {_matched()}, j AS (SELECT coalesce(g.env, '') = coalesce(p.env, '') AS same, {_FTOK('g.content')} AS gf, {_FTOK('p.content')} AS pf, {_SET("coalesce(g.content, '')")} AS gt, {_SET("coalesce(p.content, '')")} AS pt FROM mt JOIN units g ON g.unit_id = gold_id JOIN units p ON p.unit_id = pred_id),
s AS (SELECT count(*) AS matched, coalesce(avg(same::INT), 0) AS type, coalesce(avg({_F1_SETS('gf', 'pf')}), 0) AS formula, coalesce(avg({_F1_SETS('gt', 'pt')}), 0) AS content FROM j),
n AS (SELECT (SELECT count(*) FROM gold) AS units_a, (SELECT count(*) FROM pred) AS units_b, s.* FROM s), r AS (SELECT *, CASE WHEN units_b > 0 THEN matched / units_b ELSE 0 END AS precision, CASE WHEN units_a > 0 THEN matched / units_a ELSE 0 END AS recall FROM n) SELECT *, {_F1} FROM r""")
def pooled_agreement(spark, d):
    g, p = C._sides(spark, d)
    return evaluate.pooled_agreement(g, p, match.match_units(g, p).select("gold_id", "pred_id"))


_LAST = lambda m: f"(SELECT * FROM units WHERE method = '{m}' AND label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY _doc_id, label ORDER BY unit_id DESC) = 1)"


@query(f"""WITH o AS {_LAST('gold')}, n AS {_LAST('ours')}, j AS (SELECT coalesce(o._doc_id, n._doc_id) AS _doc_id, coalesce(o.label, n.label) AS label, CASE WHEN o.unit_id IS NULL THEN 'added' WHEN n.unit_id IS NULL THEN 'removed' ELSE concat_ws(',', CASE WHEN o.env IS DISTINCT FROM n.env THEN 'env' END,
 CASE WHEN left(coalesce(o.content, ''), 50) <> left(coalesce(n.content, ''), 50) THEN 'content' END, CASE WHEN (coalesce(o.proof, '') <> '') <> (coalesce(n.proof, '') <> '') THEN 'proof' END, CASE WHEN o.number_components IS DISTINCT FROM n.number_components THEN 'numbers' END) END AS change
 FROM o FULL JOIN n ON o._doc_id = n._doc_id AND o.label = n.label) SELECT * FROM j WHERE change <> ''""")
def label_changes(spark, d):
    return evaluate.label_changes(*C._sides(spark, d))


@query(f"WITH {C._LABELS} SELECT coalesce(gk._doc_id, pk._doc_id) AS _doc_id, coalesce(gk.key, pk.key) AS key, CASE WHEN pred_id IS NULL THEN 'missed' ELSE 'extra' END AS side FROM gk FULL JOIN pk ON gk._doc_id = pk._doc_id AND gk.key = pk.key WHERE gold_id IS NULL OR pred_id IS NULL")
def missed_and_extra(spark, d):
    return evaluate.missed_and_extra(*C._sides(spark, d))


def _every_method(spark, d):
    """(method, gold_id, pred_id): label matches of every method's units with the gold units."""
    units = C._units(spark, d)
    key = lambda df: df.select("method", "_doc_id", T.canonical_label(F.col("label")).alias("key"), "unit_id", F.length(F.coalesce("content", F.lit(""))).alias("size")).where("key IS NOT NULL")
    gold = key(units.where("method = 'gold'")).groupBy("_doc_id", "key").agg(F.max("unit_id").alias("gold_id"))
    pred = key(units.where("method <> 'gold'")).groupBy("method", "_doc_id", "key").agg(F.max_by("unit_id", F.struct("size", -F.col("unit_id"))).alias("pred_id"))
    return gold.join(pred, ["_doc_id", "key"]).select("method", "gold_id", "pred_id")


_METHODS = f"""keyed AS (SELECT *, {C._CANON('label')} AS key FROM units), gk AS (SELECT _doc_id, key, max(unit_id) AS gold_id FROM keyed WHERE method = 'gold' AND key IS NOT NULL GROUP BY 1, 2),
pk AS (SELECT method, _doc_id, key, unit_id AS pred_id FROM keyed WHERE method <> 'gold' AND key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY method, _doc_id, key ORDER BY length(coalesce(content, '')) DESC, unit_id) = 1),
mp AS (SELECT method, gold_id, pred_id FROM gk JOIN pk USING (_doc_id, key))"""
_BOTH_TEXTS = "coalesce(content, '') || coalesce(proof, '')"


@query(f"""WITH {_METHODS}, m AS (SELECT method, count(*) AS matched FROM mp GROUP BY 1), o AS (SELECT method, count(*) AS units, sum({C._LOST('(' + _BOTH_TEXTS + ')')}) AS lost, count(*) FILTER (WHERE {C._P2} < 1) AS parse_errors, count(*) FILTER (WHERE {C._S2} < 1) AS symbol_errors FROM units WHERE method <> 'gold' GROUP BY 1)
SELECT method, (SELECT count(*) FROM units WHERE method = 'gold') - coalesce(matched, 0) AS fn, units - coalesce(matched, 0) AS fp, lost, parse_errors, symbol_errors FROM o LEFT JOIN m USING (method)""")
def error_counts(spark, d):
    return evaluate.error_counts(C._units(spark, d), "gold", _every_method(spark, d))


_CONTENT = "coalesce(content, '')"


@query(f"""WITH {_METHODS}, u AS (SELECT method, count(*) AS units, count(*) FILTER (WHERE trim({_CONTENT}) = '') AS empty, count(*) FILTER (WHERE trim({_CONTENT}) <> '' AND length(trim({_CONTENT})) < 10) AS short, count(*) FILTER (WHERE len(_source_blocks) > 0) AS with_blocks,
 count(*) FILTER (WHERE contains({_CONTENT}, '\\begin{{') OR contains({_CONTENT}, '\\end{{')) AS environments, count(*) FILTER (WHERE contains({_CONTENT}, '$')) AS dollars, count(*) FILTER (WHERE len(regexp_extract_all({_CONTENT}, '{_FORMULA}')) > 0) AS with_formulas FROM units GROUP BY 1),
b AS (SELECT method, _doc_id, count(*) AS n FROM units GROUP BY 1, 2), gb AS (SELECT _doc_id, n AS gold FROM b WHERE method = 'gold'), c AS (SELECT method, count(*) FILTER (WHERE n <> gold) AS count_delta, (SELECT count(*) FROM gb) - count(*) AS missing_books FROM b JOIN gb USING (_doc_id) WHERE method <> 'gold' GROUP BY 1),
l AS (SELECT mp.method, count(*) FILTER (WHERE g.label IS DISTINCT FROM p.label) AS label_mismatch, count(*) FILTER (WHERE g.env IS DISTINCT FROM p.env) AS env_mismatch FROM mp JOIN units g ON g.unit_id = gold_id JOIN units p ON p.unit_id = pred_id GROUP BY 1)
SELECT method, rule, n FROM (UNPIVOT u ON COLUMNS(* EXCLUDE method) INTO NAME rule VALUE n) UNION ALL SELECT method, rule, n FROM (UNPIVOT c ON count_delta, missing_books INTO NAME rule VALUE n) UNION ALL SELECT method, rule, n FROM (UNPIVOT l ON label_mismatch, env_mismatch INTO NAME rule VALUE n)""")
def data_checks(spark, d):
    return evaluate.data_checks(C._units(spark, d), "gold", _every_method(spark, d))


@query(f"""WITH s AS (SELECT 'before' AS stage, {_BOTH_TEXTS} AS t FROM units WHERE method = 'ours' UNION ALL SELECT 'after', replace({_BOTH_TEXTS}, chr(65533), 'n') FROM units WHERE method = 'ours')
SELECT stage, count(*) AS units, count(*) FILTER (WHERE contains(t, chr(65533))) AS damaged, coalesce(sum({C._LOST('t')}), 0) AS lost, CAST(ceil(count(*) / 8) AS BIGINT) AS batches FROM s GROUP BY 1""")
def lost_before_after(spark, d):
    before = C._side(spark, d, "ours")
    fixed = [F.replace(F.col(c), F.lit(T.LOST), F.lit("n")).alias(c) for c in ("content", "proof")]
    return evaluate.lost_before_after(before, before.select(*fixed))


_WORDS = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> '')"
_BARE = "regexp_replace(regexp_replace(regexp_replace(coalesce(g.content, ''), '\\\\(begin|end)\\{[^}]*\\}', '', 'g'), '\\\\[a-zA-Z]+', '', 'g'), '[\\$\\{\\}\\\\^_]', '', 'g')"


@query(f"""WITH {C._LABELS}, w AS (SELECT gold_id, pred_id, list_distinct({_WORDS(_BARE)}) AS gw, list_distinct({_WORDS("coalesce(p.content, '')")}) AS pw FROM pairs JOIN units g ON g.unit_id = gold_id JOIN units p ON p.unit_id = pred_id)
SELECT gold_id, pred_id, len(list_intersect(gw, pw)) / len(gw) AS recall FROM w WHERE len(gw) > 0""")
def word_recall(spark, d):
    """What share of the gold words between blanks the prediction has, for looking at losses."""
    g, p = C._sides(spark, d)
    both = metrics.with_units(match.match_labels_v2(g, p).select("gold_id", "pred_id"), g, p)
    wanted, have = F.array_distinct(T.analysis_words(F.col("g.content"))), T.analysis_words(F.col("p.content"), latex=False)
    return both.where(F.size(wanted) > 0).select("gold_id", "pred_id", (F.size(F.array_intersect(wanted, have)) / F.size(wanted)).alias("recall"))


@query("SELECT unit_id, pattern FROM units, unnest(['illustrative draft results', 'replace with final', 'placeholder', 'todo', 'tbd', 'the converse']) AS t(pattern) WHERE regexp_matches(content, pattern, 'i')")
def unfinished_texts(spark, d):
    return stats.unfinished_texts(C._units(spark, d), "unit_id", "content", (*stats.UNFINISHED, "the converse"))
