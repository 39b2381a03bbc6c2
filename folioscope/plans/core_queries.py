"""Queries over the domain tables, one per operator, with the SQL that must give the same rows.

Gold units are those delivered by the method ``gold``; ``ours`` is the prediction of the pair queries.
A chapter is a book. Pages count by their latest scan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import scores as S
from folioscope.functions import text as T
from folioscope.operators import dedup, gold, layout, match, metrics, page_model, postprocess, repair, segment, stats
from folioscope.plans import pipelines
from folioscope.session import materialize, spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _units(spark, d):
    return _t(spark, d, "units")


def _side(spark, d, method):
    return _units(spark, d).where(F.col("method") == method)


def _blocks(spark, d):
    return layout.explode_blocks(layout.latest_scans(_t(spark, d, "ocr_pages")))


# --- SQL pieces -----------------------------------------------------------------------------------

_STRIP = lambda c: f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
_COLLAPSE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
_OCR = lambda c: f"lower({_COLLAPSE(f'replace(coalesce({c}, {chr(39)*2}), chr(65533), {chr(39)*2})')})"
_TOK = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
_LOST = lambda c: f"(length(coalesce({c}, '')) - length(replace(coalesce({c}, ''), chr(65533), '')))"


def _latex_sql(c, lower=True):
    out = f"coalesce({c}, '')"
    for pattern, by in ((r"\\(begin|end)\{[^}]*\}", ""), (r"\\label\{[^}]*\}", ""), (r"\\(textbf|emph|textit|mathrm|mathcal|mathbb)\{([^}]*)\}", r"\2"), (r"\\item\b", ""), (r"\$", ""), (r"\\[a-zA-Z]+", " "), (r"[{}]", "")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    out = _COLLAPSE(out)
    return f"lower({out})" if lower else out


def _residue(c):
    out = f"regexp_replace(coalesce({c}, ''), '[^()\\[\\]{{}}]', '', 'g')"
    for _ in range(12):
        out = f"regexp_replace({out}, '\\(\\)|\\[\\]|\\{{\\}}', '', 'g')"
    return out


_CANON = lambda c: f"CASE WHEN regexp_matches({c}, '(?i)(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)\\s+[\\d.]+') THEN upper(left(regexp_extract({c}, '(?i)(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)\\s+([\\d.]+)', 1), 1)) || lower(substr(regexp_extract({c}, '(?i)(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)\\s+([\\d.]+)', 1), 2)) || ' ' || regexp_replace(regexp_extract({c}, '(?i)(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)\\s+([\\d.]+)', 2), '\\.+$', '') END"
_V2ENV = "('def','thm','lem','prop','cor','ex','rem','exr')"
_V1ENV = "('def','thm','lem','prop','cor','ex','rem')"
_CLAMP = lambda x: f"greatest(0.0, least(1.0, {x}))"
_D = lambda cond, by: f" - CASE WHEN {cond} THEN {by}::DOUBLE ELSE 0::DOUBLE END"
_P2 = _CLAMP("1::DOUBLE" + _D("coalesce(label, '') = ''", .15) + _D(f"coalesce(env, '') NOT IN {_V2ENV}", .15) + _D(f"{_STRIP('content')} = ''", .3) + _D("coalesce(len(number_components), 0) = 0", .1) + _D(f"{_LOST('content')} > 3", .2) + _D(f"{_LOST('content')} BETWEEN 1 AND 3", .1) + _D("regexp_matches(coalesce(label, ''), '^(Theorem|Definition|Lemma|Corollary|Proposition)\\s+\\d+\\.\\s*$')", .15))
_TXT = "(coalesce(content, '') || ' ' || coalesce(proof, ''))"
_RATIO = f"({_LOST(_TXT)} / greatest(length({_TXT}), 1))"
_S2 = _CLAMP("1::DOUBLE" + _D(f"{_RATIO} > 0.05", .4) + _D(f"{_RATIO} > 0.01 AND {_RATIO} <= 0.05", .25) + _D(f"{_LOST(_TXT)} > 0 AND {_RATIO} <= 0.01", .1) + _D(f"{_residue(_TXT)} <> ''", .25) + _D(f"regexp_matches({_TXT}, 'Springer|DOI\\s*10\\.\\d|Universitext|©')", .2) + _D(f"length({_STRIP(_TXT)}) < 10", .15))
_CS = _STRIP("content")
_R2 = _CLAMP("1::DOUBLE" + _D("coalesce(label, '') = ''", .15) + _D(f"coalesce(env, '') NOT IN {_V2ENV}", .15) + _D(f"length({_CS}) < 20", .25) + _D(f"length({_CS}) BETWEEN 20 AND 49", .1) + _D(f"{_LOST(_CS)} / greatest(length({_CS}), 1) > 0.03", .2) + _D(f"{_LOST(_CS)} / greatest(length({_CS}), 1) > 0.01 AND {_LOST(_CS)} / greatest(length({_CS}), 1) <= 0.03", .1) + _D("coalesce(len(number_components), 0) = 0", .1) + _D("coalesce(context.section, '') = '' AND coalesce(context.section_number, 0) = 0", .15))
_GP = "gold AS (SELECT * FROM units WHERE method = 'gold'), pred AS (SELECT * FROM units WHERE method = 'ours')"
_LABELS = f"""{_GP}, gk AS (SELECT _doc_id, {_CANON('label')} AS key, max(unit_id) AS gold_id FROM gold WHERE {_CANON('label')} IS NOT NULL GROUP BY 1, 2),
pk AS (SELECT _doc_id, {_CANON('label')} AS key, unit_id AS pred_id FROM pred WHERE {_CANON('label')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY _doc_id, {_CANON('label')} ORDER BY length(coalesce(content, '')) DESC, unit_id) = 1),
pairs AS (SELECT gk._doc_id, key, gold_id, pred_id FROM gk JOIN pk USING (_doc_id, key))"""
_LATEST = "scan AS (SELECT * FROM ocr_pages QUALIFY row_number() OVER (PARTITION BY doc_id, page_id ORDER BY scanned_at DESC, scan_id DESC) = 1)"
_BLK = f"{_LATEST}, blk AS (SELECT doc_id, page_id, page_height, pos, b.block_id, b.block_type, b.text, b.bbox, b.font_size, b.is_bold FROM (SELECT doc_id, page_id, page_height, unnest(blocks) AS b, unnest(range(len(blocks))) AS pos FROM scan))"

# --- text kernel ----------------------------------------------------------------------------------


@query(f"SELECT unit_id, {_COLLAPSE('content')} AS collapsed, {_latex_sql('content')} AS plain, {_latex_sql('content', False)} AS plain_cased, {_OCR('content')} AS ocr FROM units")
def text_cleaning(spark, d):
    c = F.col("content")
    return _units(spark, d).select("unit_id", T.collapse(c).alias("collapsed"), T.strip_latex(c).alias("plain"), T.strip_latex(c, lower=False).alias("plain_cased"), T.normalize_ocr(c).alias("ocr"))


@query(f"SELECT unit_id, len(list_distinct({_TOK('coalesce(content, chr(32))')})) AS distinct_tokens, len(regexp_extract_all(lower(coalesce(content, '')), '[a-zA-Z0-9_]+|[^\\s]')) AS symbols, {_CANON('label')} AS canonical, {_LOST('content')} AS lost, {_residue('content')} = '' AS balanced FROM units")
def text_features(spark, d):
    c = F.col("content")
    return _units(spark, d).select("unit_id", F.size(T.token_set(c)).alias("distinct_tokens"), F.size(T.symbol_tokens(c)).alias("symbols"), T.canonical_label(F.col("label")).alias("canonical"), T.lost_count(c).alias("lost"), T.balanced(c).alias("balanced"))


@query(f"SELECT unit_id, {_P2} AS parse, {_S2} AS symbol, {_R2} AS retrieval FROM units")
def scores_v2(spark, d):
    u = _units(spark, d)
    c = F.col
    return u.select("unit_id", S.v2_parse(c("label"), c("env"), c("content"), c("number_components")).alias("parse"), S.v2_symbol(c("content"), c("proof")).alias("symbol"), S.v2_retrieval(c("label"), c("env"), c("content"), c("number_components"), c("context.section"), c("context.section_number")).alias("retrieval"))


_V1TXT = "(coalesce(content, '') || coalesce(list_aggregate(list_transform(_formula_spans, lambda s: ' ' || coalesce(s.text, '')), 'string_agg', ''), ''))"


@query("SELECT unit_id, CASE WHEN coalesce(label, '') = '' OR coalesce(env, '') = '' OR " + _CS + " = '' THEN 0::DOUBLE ELSE 1::DOUBLE END AS parse, "
       + _CLAMP("1::DOUBLE" + _D("coalesce(label, '') = ''", .2) + _D("coalesce(env, '') = ''", .2) + _D(f"coalesce(env, '') NOT IN {_V1ENV}", .2) + _D(f"{_CS} = ''", .2) + _D("coalesce(_doc_id, '') = ''", .1) + _D("coalesce(_page_id, '') = ''", .1)) + " AS retrieval FROM units")
def scores_v1(spark, d):
    c = F.col
    return _units(spark, d).select("unit_id", S.v1_parse(c("label"), c("env"), c("content")).alias("parse"), S.v1_retrieval(c("label"), c("env"), c("content"), c("_doc_id"), c("_page_id")).alias("retrieval"))


_TYPE = "CASE env WHEN 'def' THEN 'definition' WHEN 'thm' THEN 'theorem' WHEN 'lem' THEN 'lemma' WHEN 'prop' THEN 'proposition' WHEN 'cor' THEN 'corollary' WHEN 'ex' THEN 'example' ELSE 'other' END"
_BT = f"regexp_replace(coalesce(content, '') || ' ' || coalesce(array_to_string(list_transform(_formula_spans, lambda s: coalesce(s.text, '')), ' '), ''), '^\\s+|\\s+$', '', 'g')"


_ORDER = "CASE WHEN unit_id % 3 = 0 THEN coalesce(_source_blocks, []) || coalesce(_source_blocks, [])[1:1] WHEN unit_id % 5 = 0 THEN [] ELSE list_reverse(coalesce(_source_blocks, [])) END"


@query(f"""SELECT unit_id, CASE WHEN coalesce(_doc_id,'')='' OR coalesce(_page_id,'')='' OR {_CS} = '' OR coalesce(len(_source_blocks),0)=0 OR len({_ORDER}) = 0 THEN 0::DOUBLE ELSE 1::DOUBLE END AS parse,
CASE WHEN {_BT} = '' THEN 0::DOUBLE ELSE {_CLAMP("1::DOUBLE" + _D(f"{_residue(_BT)} <> ''", .35) + _D(f"contains({_BT}, chr(65533)) OR regexp_matches({_BT}, '(^|[^0-9A-Za-z_])[Il1]{{5,}}([^0-9A-Za-z_]|$)') OR (regexp_matches({_BT}, '[^\\x00-\\x7F]{{4,}}') AND NOT contains({_BT}, 'σ') AND NOT contains({_BT}, 'π'))", .35) + _D(f"length({_CS}) < 10", .15) + _D(f"len({_ORDER}) <> len(list_distinct({_ORDER}))", .15))} END AS symbol,
{_CLAMP("1::DOUBLE" + _D("coalesce(_doc_id,'')=''", .2) + _D("coalesce(_page_id,'')=''", .2) + _D("coalesce(len(_source_blocks),0)=0", .2) + _D(f"len({_ORDER}) = 0", .1) + _D(f"{_CS} = ''", .1))} AS retrieval FROM units""")
def scores_blocks(spark, d):
    """With reading orders of their own: reversed, with a repeat, or empty."""
    c = F.col
    spans = F.transform("_formula_spans", lambda s: F.coalesce(s["text"], F.lit("")))
    kind = metrics.env_type(c("env"))
    own = F.coalesce("_source_blocks", F.array().cast("array<int>"))
    order = F.when(c("unit_id") % 3 == 0, F.concat(own, F.slice(own, 1, 1))).when(c("unit_id") % 5 == 0, F.slice(own, 1, 0)).otherwise(F.reverse(own))
    return _units(spark, d).select("unit_id", S.blk_parse(c("_doc_id"), c("_page_id"), kind, c("content"), c("_source_blocks"), order).alias("parse"), S.blk_symbol(c("content"), spans, order).alias("symbol"), S.blk_retrieval(c("_doc_id"), c("_page_id"), kind, c("content"), c("_source_blocks"), order).alias("retrieval"))


# --- blocks and layout ----------------------------------------------------------------------------

_BS = _STRIP("text")
_NUM = f"regexp_matches({_BS}, '^\\s*\\d{{1,4}}\\s*$')"
_KEYED = r"(?i)^\s*(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise|Proof)([^\pL\pN_]|$)"
_MATH = layout.MATH_CHARACTERS


@query(f"""WITH {_BLK} SELECT doc_id, page_id, pos, CASE WHEN {_BS} = '' THEN 'empty'
 WHEN font_size > 13 OR (regexp_matches({_BS}, '^\\s*(\\d+\\.[\\d.]*)\\s+[A-Z]') AND font_size > 11) THEN 'heading'
 WHEN regexp_matches({_BS}, '{_KEYED}') THEN CASE WHEN length({_BS}) < 200 THEN 'theorem_heading' ELSE 'theorem_body' END
 WHEN (length({_BS}) - length(translate({_BS}, '{_MATH}', ''))) / length({_BS}) > 0.3 OR (length({_BS}) < 120 AND regexp_matches({_BS}, '[=≤≥]') AND length(regexp_replace({_BS}, '[^\\pL]', '', 'g')) / length({_BS}) < 0.4) THEN 'formula' ELSE 'text' END AS kind FROM blk""")
def block_types(spark, d):
    return _blocks(spark, d).select("doc_id", "page_id", F.col("pos").cast("bigint").alias("pos"), layout.classify(F.col("text"), F.col("font_size")).alias("kind"))


@query(f"""WITH {_BLK} SELECT doc_id, page_id, pos, {_BS} = '' OR coalesce(font_size < 9.5 AND ((bbox[4] > 0.91 * page_height AND regexp_matches({_BS}, '(?i)(©|DOI\\s|ISBN\\s|Springer|Universitext|10\\.\\d{{4}}/)'))
 OR (bbox[2] < 0.07 * page_height AND regexp_matches({_BS}, '^\\s*\\d+\\s+\\d+\\s+[A-Z]')) OR {_NUM}), false) AS noise FROM blk""")
def noise_blocks(spark, d):
    b = F.struct("text", "bbox", "font_size")
    return _blocks(spark, d).select("doc_id", "page_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce(layout.is_noise(b, F.col("page_height")), F.lit(False)).alias("noise"))


def _merge_sql(name: str, source: str) -> str:
    """CTEs ending in ``name``: blocks of ``source`` (numbered j from 1 on their page) with neighbours that continue each other as one.

    A recursive query holds every block against what was merged so far.
    """
    size = lambda a: f"length({_STRIP(a + '.text')})"
    gap, width = "(b.y0 - a.y1)", "least(a.x1 - a.x0, b.x1 - b.x0)"
    share = f"(CASE WHEN {width} > 0 THEN greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / {width} ELSE 0 END)"
    barred = f"a.kind = 'heading' OR b.kind = 'heading' OR regexp_matches(b.text, '{_KEYED}') OR b.kind IN ('theorem_heading', 'theorem_body') OR ({size('a')} > 50 AND {size('b')} > 50) OR {gap} > 15 OR {gap} < -10"
    allowed = f"({share} > 0.3 AND ({size('a')} < 15 OR {size('b')} < 15)) OR (abs(a.y0 - b.y0) < 8 AND b.x0 - a.x1 < 20 AND b.x0 - a.x1 > -5) OR ({size('a')} < 5 AND {size('b')} < 5 AND {gap} < 10 AND abs(a.x0 - b.x0) < 30)"
    kind = "CASE WHEN contains(a.kind, 'formula') OR contains(b.kind, 'formula') THEN 'formula' WHEN contains(a.kind, 'theorem') THEN a.kind WHEN contains(b.kind, 'theorem') THEN b.kind ELSE a.kind END"
    pick = lambda joined, own: f"CASE WHEN one THEN {joined} ELSE {own} END"
    return f"""{name}_w(doc_id, page_id, j, k, kind, text, x0, y0, x1, y1, font) AS (SELECT doc_id, page_id, j, 1, kind, text, x0, y0, x1, y1, font FROM {source} WHERE j = 1 UNION ALL
 SELECT doc_id, page_id, j, k + (NOT one)::INT, {pick('joint', 'kind')}, {pick('joined_text', 'text')}, {pick('least(ax0, x0)', 'x0')}, {pick('least(ay0, y0)', 'y0')}, {pick('greatest(ax1, x1)', 'x1')}, {pick('greatest(ay1, y1)', 'y1')}, {pick('greatest(afont, font)', 'font')}
 FROM (SELECT b.*, a.k, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, a.font AS afont, {kind} AS joint, {_STRIP('a.text')} || ' ' || {_STRIP('b.text')} AS joined_text, NOT ({barred}) AND ({allowed}) AS one FROM {name}_w a JOIN {source} b ON b.doc_id = a.doc_id AND b.page_id = a.page_id AND b.j = a.j + 1)),
{name} AS (SELECT * EXCLUDE (j, k), k AS j FROM {name}_w QUALIFY row_number() OVER (PARTITION BY doc_id, page_id, k ORDER BY j DESC) = 1)"""


_NOISE_SQL = f"{_BS} = '' OR coalesce(font_size < 9.5 AND ((bbox[4] > 0.91 * page_height AND regexp_matches({_BS}, '(?i)(©|DOI\\s|ISBN\\s|Springer|Universitext|10\\.\\d{{4}}/)')) OR (bbox[2] < 0.07 * page_height AND regexp_matches({_BS}, '^\\s*\\d+\\s+\\d+\\s+[A-Z]')) OR {_NUM}), false)"
_NORMAL = f"""{_BLK.replace('blk AS (', 'raw AS (')}, kept AS (SELECT doc_id, page_id, block_type AS kind, text, coalesce(bbox[1], 0) AS x0, coalesce(bbox[2], 0) AS y0, coalesce(bbox[3], 0) AS x1, coalesce(bbox[4], 0) AS y1, coalesce(font_size, 10) AS font, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY coalesce(bbox[2], 0), pos) AS i FROM raw WHERE NOT ({_NOISE_SQL})),
lines(doc_id, page_id, i, anchor, line) AS (SELECT doc_id, page_id, i, y0, 0 FROM kept WHERE i = 1 UNION ALL SELECT n.doc_id, n.page_id, n.i, CASE WHEN n.y0 - l.anchor > 8 THEN n.y0 ELSE l.anchor END, l.line + (n.y0 - l.anchor > 8)::INT FROM lines l JOIN kept n ON n.doc_id = l.doc_id AND n.page_id = l.page_id AND n.i = l.i + 1),
placed AS (SELECT kept.* EXCLUDE (i), row_number() OVER (PARTITION BY doc_id, page_id ORDER BY line, x0, i) AS j FROM kept JOIN lines USING (doc_id, page_id, i)), {_merge_sql('once', 'placed')}, {_merge_sql('twice', 'once')}"""


@query(f"""WITH RECURSIVE {_NORMAL}, packed AS (SELECT doc_id, page_id, list(struct_pack(block_id := (j - 1)::INTEGER, block_type := kind, text := text) ORDER BY j) AS blocks FROM twice GROUP BY 1, 2)
SELECT doc_id, page_id, coalesce(len(packed.blocks), 0)::INTEGER AS num_blocks, coalesce(packed.blocks, []) AS blocks FROM scan LEFT JOIN packed USING (doc_id, page_id)""")
def normalized_pages(spark, d):
    pages = layout.normalize_pages(spread(layout.latest_scans(_t(spark, d, "ocr_pages"))))
    named = F.transform("blocks", lambda b: F.struct(b["block_id"].alias("block_id"), b["block_type"].alias("block_type"), b["text"].alias("text")))
    return pages.select("doc_id", "page_id", "num_blocks", named.alias("blocks"))


@query(f"""WITH {_BLK}, n AS (SELECT doc_id, page_id, block_type, {_BS} AS t, bbox[2] AS y0, bbox[4] AS y1, bbox[1] AS x0, lead(bbox[2]) OVER w AS ny0, lead(bbox[1]) OVER w AS nx0, lead({_BS}) OVER w AS nt, lead(block_type) OVER w AS nk FROM blk WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY pos))
SELECT doc_id, page_id, count(*) AS blocks, count(*) FILTER (WHERE length(t) BETWEEN 1 AND 9 AND block_type <> 'image') AS tiny, count(*) FILTER (WHERE ny0 < y0 - 20 AND ny0 > 50) AS out_of_order,
 count(*) FILTER (WHERE block_type IN ('text','formula') AND nk IN ('text','formula') AND abs(x0 - nx0) < 5 AND abs(ny0 - y1) < 5 AND NOT regexp_matches(t, '[.!?:;]$') AND regexp_matches(nt, '^[a-z]')) AS fragmented FROM n GROUP BY 1, 2""")
def block_diagnostics(spark, d):
    return stats.block_diagnostics(_blocks(spark, d), ["doc_id", "page_id"])


@query(f"""SELECT scan_id, doc_id, page_id, nullif(regexp_extract(page_id, '(\\d+)$', 1), '') AS pdf_page_no, len(blocks) AS ocr_block_count,
CAST(len(blocks) > 0 AND len(list_filter(blocks, lambda b: regexp_matches(b.text, '(?i)[=∑∫∀∃≤≥λμσπ]|\\\\[a-zA-Z]+|\\bmath\\b'))) >= 0.2 * len(blocks) AS INTEGER) AS has_formula_dense,
CAST(contains(lower(array_to_string(list_transform(blocks, lambda b: b.text), ' ')), 'proof') AS INTEGER) AS has_proof_adjacent FROM ocr_pages""")
def page_features(spark, d):
    return stats.page_features(_t(spark, d, "ocr_pages"))


_START = f"(NOT regexp_matches({_BS}, '(?i)^\\s*Proof([^\\pL\\pN_]|$)') AND (regexp_matches({_BS}, '(?i)^\\s*(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)') OR block_type IN ('theorem_heading','theorem_body')))"
_PROVES = f"regexp_matches({_BS}, '(?i)^\\s*Proof([^\\pL\\pN_]|$)')"
_HEADS = f"(block_type = 'heading' OR (font_size > 13 AND regexp_matches({_BS}, '^\\s*(\\d+\\.[\\d.]*)\\s+[A-Z]')))"
_SEG = f"""{_BLK}, f AS (SELECT *, {_START} AS starts, {_HEADS} AS heads, {_PROVES} AS proves FROM blk), g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id, page_id ORDER BY pos) AS unit FROM f),
h AS (SELECT *, min(CASE WHEN NOT starts AND (heads OR proves) THEN pos END) OVER u AS stop FROM g WHERE unit > 0 WINDOW u AS (PARTITION BY doc_id, page_id, unit)),
i AS (SELECT *, min(CASE WHEN pos = stop AND proves THEN pos END) OVER u AS proof_at FROM h WINDOW u AS (PARTITION BY doc_id, page_id, unit)),
j AS (SELECT *, min(CASE WHEN pos > proof_at AND heads THEN pos END) OVER u AS head_at, min(CASE WHEN pos > proof_at AND regexp_matches(text, '[□■∎]|(^|[^\\pL\\pN_])Q\\.?E\\.?D\\.?') THEN pos END) OVER u AS mark_at FROM i WINDOW u AS (PARTITION BY doc_id, page_id, unit)),
k AS (SELECT *, CASE WHEN starts OR (pos < coalesce(stop, 2147483647) AND block_type <> 'image') THEN 'content' WHEN pos >= proof_at AND pos < coalesce(head_at, 2147483647) AND pos <= coalesce(mark_at, 2147483647) THEN 'proof' END AS part FROM j)"""


_KINDS_SQL = "(?i)^(Definition|Theorem|Lemma|Proposition|Corollary|Example|Remark|Exercise)"
_CARRIED = f"""hd AS (SELECT doc_id, page_id, arg_max(split_part({_BS}, chr(10), 1), pos) FILTER (WHERE {_HEADS} AND regexp_matches(split_part({_BS}, chr(10), 1), '^(\\d+)\\.(\\d+)\\s+(.+)')) AS line FROM blk GROUP BY 1, 2),
cs AS (SELECT doc_id, page_id, last_value(line IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_id) AS line FROM hd),
sec AS (SELECT doc_id, page_id, coalesce(regexp_extract(line, '^(\\d+)\\.(\\d+)\\s+(.+)', 3), '') AS section, coalesce(TRY_CAST(regexp_extract(line, '^(\\d+)\\.(\\d+)\\s+(.+)', 2) AS INTEGER), 0) AS section_number FROM cs)"""


@query(f"""WITH {_SEG}, {_CARRIED}, un AS (SELECT doc_id, page_id, CAST(unit AS INTEGER) AS unit_index, max({_BS}) FILTER (WHERE starts) AS head, coalesce(list(block_id ORDER BY pos) FILTER (WHERE part = 'content'), []) AS source_blocks, coalesce(list(block_id ORDER BY pos) FILTER (WHERE part = 'proof'), []) AS proof_blocks,
coalesce(string_agg(CASE WHEN {_BS} <> '' THEN {_BS} END, ' ' ORDER BY pos) FILTER (WHERE part = 'content'), '') AS content, coalesce(string_agg(CASE WHEN {_BS} <> '' THEN {_BS} END, ' ' ORDER BY pos) FILTER (WHERE part = 'proof'), '') AS proof,
coalesce(list(struct_pack(t := {_BS}, b := block_id) ORDER BY pos) FILTER (WHERE part = 'content' AND block_type = 'formula'), []) AS fs FROM k WHERE part IS NOT NULL GROUP BY 1, 2, 3),
ti AS (SELECT *, trim(regexp_replace(split_part(head, chr(10), 1), '^\\s+|\\s+$', '', 'g')) AS title, lower(regexp_extract(head, '{_KINDS_SQL}', 1)) AS word FROM un),
la AS (SELECT *, CASE WHEN regexp_matches(title, '{_KINDS_SQL}\\s+[\\d.]+') THEN upper(left(regexp_extract(title, '{_KINDS_SQL}', 1), 1)) || lower(substr(regexp_extract(title, '{_KINDS_SQL}', 1), 2)) || ' ' || rtrim(regexp_extract(title, '{_KINDS_SQL}\\s+([\\d.]+)', 2), '.') ELSE title END AS label FROM ti)
SELECT doc_id, page_id, unit_index, label, CASE word WHEN 'definition' THEN 'def' WHEN 'theorem' THEN 'thm' WHEN 'lemma' THEN 'lem' WHEN 'proposition' THEN 'prop' WHEN 'corollary' THEN 'cor' WHEN 'example' THEN 'ex' WHEN 'exercise' THEN 'exr' ELSE 'rem' END AS env,
list_transform(list_filter(string_split(CASE WHEN contains(label, ' ') THEN substr(label, strpos(label, ' ') + 1) ELSE '' END, '.'), lambda x: regexp_full_match(x, '\\d+')), lambda x: x::INTEGER) AS number_components,
content, proof, source_blocks, proof_blocks, list_transform(fs, lambda f, i: struct_pack(formula_id := printf('f_%s_%02d', page_id, i), text := f.t, source_block := f.b)) AS formula_spans, section, section_number FROM la JOIN sec USING (doc_id, page_id)""")
def segment_units(spark, d):
    return segment.extract_units(_blocks(spark, d))


@query(f"""WITH {_BLK}, hd AS (SELECT doc_id, page_id, arg_max(split_part({_BS}, chr(10), 1), pos) FILTER (WHERE {_HEADS} AND regexp_matches(split_part({_BS}, chr(10), 1), '^(\\d+)\\.(\\d+)\\s+(.+)')) AS line FROM blk GROUP BY 1, 2),
c AS (SELECT doc_id, page_id, last_value(line IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_id) AS line FROM hd)
SELECT doc_id, page_id, coalesce(regexp_extract(line, '^(\\d+)\\.(\\d+)\\s+(.+)', 3), '') AS section, coalesce(TRY_CAST(regexp_extract(line, '^(\\d+)\\.(\\d+)\\s+(.+)', 2) AS INTEGER), 0) AS section_number FROM c""")
def section_carry_forward(spark, d):
    return segment.carry_section(_blocks(spark, d))


_NORMAL_BLOCKS = "blk AS (SELECT doc_id, page_id, (j - 1)::BIGINT AS pos, (j - 1)::INTEGER AS block_id, kind AS block_type, text, font AS font_size FROM twice)"
_UNITS_SQL = ORACLE["segment_units"].replace(f"WITH {_BLK}", f"WITH RECURSIVE {_NORMAL}, {_NORMAL_BLOCKS}")


@query(f"SELECT doc_id, page_id, label, env, content, proof FROM ({_UNITS_SQL}) QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY page_id, unit_index) = 1")
def structure_aware_units(spark, d):
    return pipelines.structure_units(spread(layout.latest_scans(_t(spark, d, "ocr_pages")))).select("doc_id", "page_id", "label", "env", "content", "proof")


# --- duplicates -----------------------------------------------------------------------------------


@query("SELECT unit_id, _doc_id, label FROM units QUALIFY row_number() OVER (PARTITION BY _doc_id, label ORDER BY unit_id) = 1")
def dedup_first(spark, d):
    return dedup.first_by_label(_units(spark, d).select("unit_id", "_doc_id", "label"))


@query("SELECT unit_id, _doc_id, label FROM units WHERE regexp_matches(label, '\\S') QUALIFY row_number() OVER (PARTITION BY _doc_id, label ORDER BY length(coalesce(content, '')) DESC, unit_id) = 1")
def dedup_longest(spark, d):
    return dedup.longest_by_label(_units(spark, d).select("unit_id", "_doc_id", "label", "content"), drop_blank=True).select("unit_id", "_doc_id", "label")


@query("SELECT unit_id, _doc_id, row_number() OVER (PARTITION BY _doc_id ORDER BY CASE WHEN coalesce(len(number_components), 0) = 0 THEN [0] ELSE number_components END, unit_id) AS new_index FROM units")
def reindex_by_numbers(spark, d):
    return dedup.reindex(_units(spark, d).select("unit_id", "_doc_id", "number_components")).select("unit_id", "_doc_id", F.col("new_index").cast("bigint").alias("new_index"))


# --- matching and metrics -------------------------------------------------------------------------


def _sides(spark, d):
    return _side(spark, d, "gold"), _side(spark, d, "ours")


@query(f"WITH {_LABELS} SELECT coalesce(gk._doc_id, pk._doc_id) AS _doc_id, coalesce(gk.key, pk.key) AS key, gold_id, pred_id FROM gk FULL JOIN pk ON gk._doc_id = pk._doc_id AND gk.key = pk.key")
def label_match_v1(spark, d):
    return match.match_labels_v1(*_sides(spark, d))


@query(f"WITH {_LABELS} SELECT * FROM pairs")
def label_match_v2(spark, d):
    return match.match_labels_v2(*_sides(spark, d))


_PAIRSQL = f"""{_LABELS}, j AS (SELECT pairs._doc_id, g.content AS gc, p.content AS pc, g.env AS ge, p.env AS pe FROM pairs JOIN units g ON g.unit_id = gold_id JOIN units p ON p.unit_id = pred_id),
t AS (SELECT *, {_latex_sql('gc')} AS gt, {_OCR('pc')} AS pt FROM j), s AS (SELECT *, list_distinct({_TOK('gt')}) AS gs, list_distinct({_TOK('pt')}) AS ps FROM t)"""


@query(f"""WITH {_LABELS}, m AS (SELECT _doc_id, count(*) AS matched FROM pairs GROUP BY 1), gn AS (SELECT _doc_id, count(*) AS gold FROM gold GROUP BY 1), pn AS (SELECT _doc_id, count(*) AS pred FROM pred GROUP BY 1),
c AS (SELECT coalesce(gn._doc_id, pn._doc_id) AS _doc_id, coalesce(matched, 0) AS matched, coalesce(gold, 0) AS gold, coalesce(pred, 0) AS pred FROM gn FULL JOIN pn ON gn._doc_id = pn._doc_id LEFT JOIN m ON m._doc_id = coalesce(gn._doc_id, pn._doc_id)),
r AS (SELECT *, CASE WHEN pred > 0 THEN matched / pred ELSE 0 END AS precision, CASE WHEN gold > 0 THEN matched / gold ELSE 0 END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r""")
def boundary_prf(spark, d):
    g, p = _sides(spark, d)
    return metrics.boundary_scores(match.match_labels_v2(g, p), g, p, ["_doc_id"])


_EDGE = """gold AS (SELECT * FROM units WHERE method = 'gold'), pred AS (SELECT * FROM units WHERE method = 'ours'),
ge AS (SELECT _doc_id, _page_id, coalesce(list_min(_source_blocks), -1) AS a, coalesce(list_max(_source_blocks), -1) AS b, unit_id AS gold_id, _source_blocks AS gb, env AS ge FROM gold QUALIFY row_number() OVER (PARTITION BY _doc_id, _page_id, a, b ORDER BY unit_id DESC) = 1),
pe AS (SELECT _doc_id, _page_id, coalesce(list_min(_source_blocks), -1) AS a, coalesce(list_max(_source_blocks), -1) AS b, unit_id AS pred_id, _source_blocks AS pb, env AS pe FROM pred QUALIFY row_number() OVER (PARTITION BY _doc_id, _page_id, a, b ORDER BY unit_id DESC) = 1)"""


@query(f"WITH {_EDGE} SELECT gold_id, pred_id, CASE WHEN len(list_distinct(coalesce(gb,[]) || coalesce(pb,[]))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(gb), list_distinct(pb))) / len(list_distinct(gb || pb)) END AS block_overlap, (ge IS NOT DISTINCT FROM pe)::INT AS same_env FROM ge JOIN pe USING (_doc_id, _page_id, a, b)")
def boundary_exact_match(spark, d):
    pairs = match.block_pairs(*_sides(spark, d), ["_doc_id", "_page_id"])
    return pairs.select("gold_id", "pred_id", T.jaccard(F.array_distinct("gold_blocks"), F.array_distinct("pred_blocks"), 1.0).alias("block_overlap"), F.col("gold_env").eqNullSafe(F.col("pred_env")).cast("int").alias("same_env"))


@query(f"""WITH {_LABELS}, ch AS (SELECT DISTINCT doc_id, page_id FROM page_manifest WHERE is_challenge = 1) SELECT count(*) AS matched FROM pairs JOIN units g ON g.unit_id = gold_id WHERE EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = g._doc_id AND ch.page_id = g._page_id)""")
def challenge_semijoin(spark, d):
    g, p = _sides(spark, d)
    hard = _t(spark, d, "page_manifest").where("is_challenge = 1").select(F.col("doc_id").alias("_doc_id"), F.col("page_id").alias("_page_id")).distinct()
    pairs = match.match_labels_v2(g, p)
    return g.select("_doc_id", "_page_id", F.col("unit_id").alias("gold_id")).join(hard, ["_doc_id", "_page_id"], "left_semi").join(pairs.select("gold_id"), "gold_id").agg(F.count(F.lit(1)).alias("matched"))


_FB = lambda a: f"list_sort(list_distinct(list_transform(coalesce({a}, []), lambda s: s.source_block)))"


@query(f"""WITH {_EDGE}, u AS (SELECT coalesce(ge._doc_id, pe._doc_id) AS _doc_id, coalesce(ge._page_id, pe._page_id) AS _page_id, gold_id IS NOT NULL AND pred_id IS NOT NULL AS common, ge, pe, x._formula_spans AS gf, y._formula_spans AS pf FROM ge FULL JOIN pe ON ge._doc_id = pe._doc_id AND ge._page_id = pe._page_id AND ge.a = pe.a AND ge.b = pe.b LEFT JOIN units x ON x.unit_id = gold_id LEFT JOIN units y ON y.unit_id = pred_id)
SELECT _doc_id, _page_id, count(*) FILTER (WHERE common) / count(*) AS boundary, coalesce(avg((ge IS NOT DISTINCT FROM pe)::INT) FILTER (WHERE common), 1) AS type, coalesce(avg(({_FB('gf')} = {_FB('pf')})::INT) FILTER (WHERE common), 1) AS formula FROM u GROUP BY 1, 2""")
def agreement_by_page(spark, d):
    return metrics.agreement(*_sides(spark, d), ["_doc_id", "_page_id"])


@query(f"""WITH {_EDGE}, u AS (SELECT coalesce(ge._doc_id, pe._doc_id) AS d, coalesce(ge._page_id, pe._page_id) AS p, gold_id IS NOT NULL AND pred_id IS NOT NULL AS common, ge, pe, x._formula_spans AS gf, y._formula_spans AS pf FROM ge FULL JOIN pe ON ge._doc_id = pe._doc_id AND ge._page_id = pe._page_id AND ge.a = pe.a AND ge.b = pe.b LEFT JOIN units x ON x.unit_id = gold_id LEFT JOIN units y ON y.unit_id = pred_id),
g AS (SELECT count(*) FILTER (WHERE common) / count(*) AS boundary, coalesce(avg((ge IS NOT DISTINCT FROM pe)::INT) FILTER (WHERE common), 1) AS type, coalesce(avg(({_FB('gf')} = {_FB('pf')})::INT) FILTER (WHERE common), 1) AS formula FROM u GROUP BY d, p) SELECT count(*) AS pages, avg(boundary) AS boundary, avg(type) AS type, avg(formula) AS formula FROM g""")
def agreement_mean(spark, d):
    per = metrics.agreement(*_sides(spark, d), ["_doc_id", "_page_id"])
    return per.agg(F.count(F.lit(1)).alias("pages"), *[F.avg(c).alias(c) for c in ("boundary", "type", "formula")])



@query(f"""WITH {_GP}, gk AS (SELECT {_CANON('label')} AS key, max(unit_id) AS gold_id FROM gold WHERE {_CANON('label')} IS NOT NULL GROUP BY 1),
pk AS (SELECT {_CANON('label')} AS key, unit_id AS pred_id FROM pred WHERE {_CANON('label')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_CANON('label')} ORDER BY length(coalesce(content, '')) DESC, unit_id) = 1)
SELECT key, gold_id, pred_id FROM gk JOIN pk USING (key)""")
def micro_pool_then_match(spark, d):
    pool = lambda df: df.withColumn("_doc_id", F.lit("all"))
    g, p = _sides(spark, d)
    return match.match_labels_v2(pool(g), pool(p)).select("key", "gold_id", "pred_id")


@query(f"""SELECT method, count(*) AS units, sum({_LOST('content')}) AS lost, count(*) FILTER (WHERE {_P2} < 1) AS parse_below_1, count(*) FILTER (WHERE {_S2} < 1) AS symbol_below_1 FROM units GROUP BY 1""")
def error_table(spark, d):
    c = F.col
    u = _units(spark, d)
    return u.groupBy("method").agg(F.count(F.lit(1)).alias("units"), F.sum(T.lost_count(c("content"))).alias("lost"), F.count_if(S.v2_parse(c("label"), c("env"), c("content"), c("number_components")) < 1).alias("parse_below_1"), F.count_if(S.v2_symbol(c("content"), c("proof")) < 1).alias("symbol_below_1"))


@query("SELECT method, sum(llm_calls) AS calls, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, sum(total_tokens) AS total_tokens, sum(wall_time_seconds) AS seconds, count(DISTINCT doc_id) AS books FROM (SELECT DISTINCT * FROM run_stats) GROUP BY 1")
def cost_rollup(spark, d):
    runs = _t(spark, d, "run_stats").distinct()
    return runs.groupBy("method").agg(F.sum("llm_calls").alias("calls"), *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.sum("wall_time_seconds").alias("seconds"), F.count_distinct("doc_id").alias("books"))


@query("""SELECT method || '/' || doc_id || '/' || chapter AS run, 'sum' AS rule, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS expected, total_tokens AS found FROM run_stats WHERE total_tokens IS NOT NULL AND total_tokens <> coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)
UNION ALL SELECT method || '/' || doc_id || '/' || chapter, 'missing', coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0), NULL FROM run_stats WHERE total_tokens IS NULL""")
def consistency_violations(spark, d):
    runs = _t(spark, d, "run_stats").withColumn("run", F.concat_ws("/", "method", "doc_id", F.col("chapter").cast("string")))
    return stats.violations(runs, "run", "total_tokens", ["prompt_tokens", "completion_tokens"])


@query("SELECT DISTINCT method, doc_id FROM run_stats r WHERE NOT EXISTS (SELECT 1 FROM run_stats s WHERE s.method = r.method AND s.doc_id = r.doc_id AND s.total_tokens > 0)")
def rerun_needed(spark, d):
    runs = _t(spark, d, "run_stats")
    return pipelines.rerun_needed(runs, runs)


@query(f"""WITH m AS (SELECT doc_id, page_id, min(split) AS split FROM page_manifest GROUP BY 1, 2), u AS (SELECT split, {_TYPE} AS kind, _source_blocks AS sb, _formula_spans AS fs FROM units JOIN m ON doc_id = _doc_id AND page_id = _page_id WHERE method = 'gold')
SELECT split, count(*) AS theorem_units, count(*) FILTER (WHERE kind = 'definition') AS definitions, count(*) FILTER (WHERE kind IN ('theorem','lemma','proposition','corollary')) AS theorem_like, count(*) FILTER (WHERE kind = 'example') AS examples,
avg(coalesce(len(sb), 0)) AS avg_blocks_per_unit, avg(coalesce(len(fs), 0)) AS avg_formulas_per_unit, avg((len(sb) > 1)::INT) AS multi_block_unit_ratio FROM u GROUP BY ROLLUP (split)""")
def split_summary(spark, d):
    pages = _t(spark, d, "page_manifest").groupBy(F.col("doc_id").alias("_doc_id"), F.col("page_id").alias("_page_id")).agg(F.min("split").alias("split"))
    u = _side(spark, d, "gold").join(pages, ["_doc_id", "_page_id"]).withColumn("kind", metrics.env_type(F.col("env")))
    return stats.split_summary(u, "split", "kind", "_source_blocks", "_formula_spans")


@query("SELECT method, coalesce(len(_source_blocks), 0) + coalesce(len(_proof_blocks), 0) AS blocks, count(*) AS units, count(*) / sum(count(*)) OVER (PARTITION BY method) AS share FROM units GROUP BY 1, 2")
def blocks_per_unit(spark, d):
    from pyspark.sql import Window

    n = (F.greatest(F.size(F.coalesce("_source_blocks", F.array())), F.lit(0)) + F.greatest(F.size(F.coalesce("_proof_blocks", F.array())), F.lit(0))).cast("bigint")
    hist = _units(spark, d).groupBy("method", n.alias("blocks")).agg(F.count(F.lit(1)).alias("units"))
    return hist.withColumn("share", F.col("units") / F.sum("units").over(Window.partitionBy("method")))


@query(f"SELECT method, avg(len(regexp_extract_all(coalesce(content, ''), '[a-zA-Z0-9_]+|[^\\s]'))) AS avg_tokens_per_unit, avg(coalesce(len(_formula_spans), 0)) AS avg_formulas_per_unit, avg(CASE WHEN coalesce(label, '') <> '' AND len(_source_blocks) >= 2 AND _source_blocks[2] - _source_blocks[1] > 1 THEN 1 ELSE 0 END) AS detached_heading_ratio, avg(regexp_matches(coalesce(m.notes, ''), '(?i)proof_adjacent|adjacent_to_proof')::INT) AS proof_adjacent_ratio, avg(round(length(coalesce(label, '')) / 100, 4)) AS avg_ocr_confidence FROM units LEFT JOIN (SELECT doc_id, page_id, max(notes) AS notes FROM page_manifest GROUP BY 1, 2) m ON m.doc_id = _doc_id AND m.page_id = _page_id GROUP BY 1")
def descriptive_stats(spark, d):
    """A unit's notes are its page's; the delivered tables have no confidence, so the labels' lengths stand in for one."""
    notes = _t(spark, d, "page_manifest").groupBy(F.col("doc_id").alias("_doc_id"), F.col("page_id").alias("_page_id")).agg(F.max("notes").alias("notes"))
    units = _units(spark, d).join(notes, ["_doc_id", "_page_id"], "left").withColumn("confidence_score", F.round(F.length(F.coalesce("label", F.lit(""))) / 100, 4))
    return stats.descriptive(units, ["method"])


@query(f"WITH {_PAIRSQL.replace('pairs._doc_id,', 'pairs._doc_id, gold_id, pred_id,')} SELECT gold_id, pred_id, CASE WHEN len(gs) = 0 THEN 1.0 ELSE len(list_intersect(gs, ps)) / len(gs) END AS completeness FROM s ORDER BY 3, 1 LIMIT 8")
def worst_units(spark, d):
    g, p = _sides(spark, d)
    pairs = match.match_labels_v2(g, p).select("_doc_id", "gold_id", "pred_id")
    scored = metrics.pair_scores(metrics.with_units(pairs, g, p)).select("gold_id", "pred_id", "completeness")
    return dedup.worst(scored, F.col("completeness"), 8, seq="gold_id")


@query(f"WITH {_GP} SELECT DISTINCT _doc_id, {_CANON('label')} AS key FROM gold WHERE {_CANON('label')} IS NOT NULL EXCEPT SELECT _doc_id, {_CANON('label')} FROM pred")
def missed_labels(spark, d):
    keys = lambda df: df.select("_doc_id", T.canonical_label(F.col("label")).alias("key")).where("key IS NOT NULL").distinct()
    g, p = _sides(spark, d)
    return keys(g).exceptAll(keys(p))


@query("""WITH a AS (SELECT _doc_id, unit_index, min(unit_id) AS i FROM units WHERE method = 'gold' GROUP BY 1, 2), b AS (SELECT _doc_id, unit_index, min(unit_id) AS i FROM units WHERE method = 'ours' GROUP BY 1, 2),
f AS (SELECT unit_id, unnest(['label', 'env', 'content', 'proof']) AS field, unnest([coalesce(label, ''), coalesce(env, ''), coalesce(content, ''), coalesce(proof, '')]) AS v FROM units),
j AS (SELECT a._doc_id, a.unit_index, x.field, x.v AS x, y.v AS y FROM a JOIN b USING (_doc_id, unit_index) JOIN f x ON x.unit_id = a.i JOIN f y ON y.unit_id = b.i AND y.field = x.field WHERE x.v <> y.v)
SELECT _doc_id, unit_index, field, length(y) - length(x) AS delta, list_position(list_transform(range(1, greatest(length(x), length(y)) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1)), true) - 1 AS differs_at FROM j""")
def positional_diff(spark, d):
    one = lambda m: dedup.keep_first(_side(spark, d, m).select("_doc_id", "unit_index", "unit_id", "label", "env", "content", "proof"), ["_doc_id", "unit_index"], [F.col("unit_id")])
    a, b = one("gold"), one("ours")
    fields = [stats.positional_diff(a, b, ["_doc_id", "unit_index"], f).withColumn("field", F.lit(f)) for f in ("label", "env", "content", "proof")]
    out = fields[0]
    for f in fields[1:]:
        out = out.unionByName(f)
    return out


@query("""WITH u AS (SELECT unit_id, content, length(content) - length(replace(content, chr(65533), '')) AS n FROM units WHERE contains(content, chr(65533))), c AS (SELECT unit_id, unnest(string_split(content, chr(65533))) AS part, generate_subscripts(string_split(content, chr(65533)), 1) AS i, n FROM u)
SELECT unit_id, string_agg(part || CASE WHEN i > n THEN '' WHEN i % 3 = 0 THEN chr(65533) ELSE chr(96 + (i % 26)::INTEGER) END, '' ORDER BY i) AS repaired FROM c GROUP BY 1""")
def positional_fixes(spark, d):
    """Another letter at every place, and every third place left as it is."""
    u = _units(spark, d).where(F.col("content").contains(T.LOST)).select("unit_id", "content")
    numbered = F.transform(T.repair_contexts(F.col("content")), lambda r, i: F.struct(r["pos"].alias("k"), F.when((i + 1) % 3 != 0, F.char(96 + (i + 1) % 26)).alias("v")))
    return u.select("unit_id", T.apply_at(F.col("content"), F.map_from_entries(numbered)).alias("repaired"))


@query("""WITH p AS (SELECT unit_id, replace(content, chr(10), ' ') AS t, content, unnest(list_filter(range(1, length(content) + 1), lambda i: substr(content, i, 1) = chr(65533))) AS i FROM units WHERE contains(content, chr(65533)))
SELECT unit_id, i - 1 AS pos, substr(t, greatest(i - 30, 1), i + 31 - greatest(i - 30, 1)) AS context FROM p""")
def repair_contexts(spark, d):
    u = _units(spark, d).where(F.col("content").contains(T.LOST)).select("unit_id", F.explode(T.repair_contexts(F.col("content"))).alias("r"))
    return u.select("unit_id", F.col("r.pos").cast("bigint").alias("pos"), F.col("r.context").alias("context"))


_ONCE = lambda t, a, b: f"CASE WHEN contains({t}, '{a}') THEN left({t}, strpos({t}, '{a}') - 1) || '{b}' || substr({t}, strpos({t}, '{a}') + {len(a)}) ELSE {t} END"
_EDITS = (("the ", "THE "), ("THE ", "a "), ("of a", "of one"), ("every", "each"))


def _edits_sql(column: str) -> str:
    """Each edit in its own subquery, so that the text is not written out again and again."""
    inner = f"SELECT unit_id, coalesce({column}, '') AS t, 0 AS h FROM units"
    for a, b in _EDITS:
        inner = f"SELECT unit_id, {_ONCE('t', a, b)} AS t, h + contains(t, '{a}')::INT AS h FROM ({inner})"
    return inner


@query(f"SELECT unit_id, c.t AS content, p.t AS proof, c.h + p.h AS hits FROM ({_edits_sql('content')}) c JOIN ({_edits_sql('proof')}) p USING (unit_id)")
def first_occurrence_fixes(spark, d):
    """Edits that follow on each other, in content and proof."""
    fixes = F.array(*[F.struct(F.lit(a).alias("find"), F.lit(b).alias("replace")) for a, b in _EDITS])
    done = _units(spark, d).select("unit_id", T.apply_once(F.col("content"), fixes).alias("c"), T.apply_once(F.col("proof"), fixes).alias("p"))
    return done.select("unit_id", F.col("c.text").alias("content"), F.col("p.text").alias("proof"), (F.col("c.hits") + F.col("p.hits")).alias("hits"))


@query("SELECT _doc_id, CAST(floor((row_number() OVER (PARTITION BY _doc_id ORDER BY unit_id) - 1) / 8) AS INTEGER) AS batch, unit_id FROM units WHERE contains(content, chr(65533)) OR contains(proof, chr(65533))")
def repair_batches(spark, d):
    return repair.batches(_units(spark, d).select("_doc_id", "unit_id", "content", "proof")).select("_doc_id", "batch", "unit_id")


@query()
def located_gold(spark, d):
    g = _side(spark, d, "gold").select("_doc_id", "unit_id", "label", "content")
    return gold.locate_units(g, _blocks(spark, d)).select("doc_id", "unit_id", "page_id", "score")


@query("SELECT method, env, count(*) AS units FROM units GROUP BY 1, 2")
def env_histogram(spark, d):
    return _units(spark, d).groupBy("method", "env").agg(F.count(F.lit(1)).alias("units"))


@query(f"WITH {_PAIRSQL.replace('pairs._doc_id,', 'pairs._doc_id, gold_id, pred_id,')}, e AS (SELECT gold_id, pred_id, abs(length(gt) - length(pt)) AS gap FROM s) SELECT gold_id, pred_id, gap FROM e ORDER BY gap DESC, gold_id LIMIT 8")
def worst_units_by_length(spark, d):
    """The largest differences first; the lengths stand for the edit distance, which the evaluation queries compare."""
    g, p = _sides(spark, d)
    pairs = metrics.with_units(match.match_labels_v2(g, p).select("gold_id", "pred_id"), g, p)
    gap = F.abs(F.length(T.strip_latex(F.col("g.content"))) - F.length(T.normalize_ocr(F.col("p.content")))).cast("bigint")
    return dedup.worst(pairs.select("gold_id", "pred_id", gap.alias("gap")), F.col("gap"), 8, descending=True, seq="gold_id")


# --- outside models -------------------------------------------------------------------------------

_PAGE_WORDS = "definition|theorem|lemma|corollary|proposition|remark|example|exercise|proof"


@query(f"""WITH {_LATEST}, pg AS (SELECT doc_id, page_id, blocks, len(list_filter(blocks, lambda b: regexp_matches(lower(coalesce(b.text, '')), '{_PAGE_WORDS}'))) > 0 AS asked,
 list_filter(list_transform(blocks, lambda b: CASE WHEN b.block_type = 'heading' THEN regexp_replace(coalesce(b.text, ''), '^\\s+|\\s+$', '', 'g') END), lambda t: regexp_matches(t, '^(\\d+)\\.(\\d+)\\s+(.+)')) AS heads FROM scan),
c AS (SELECT doc_id, page_id, blocks, asked, last_value(CASE WHEN asked AND len(heads) > 0 THEN heads[-1] END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_id) AS line FROM pg)
SELECT doc_id || '/' || page_id AS key, coalesce(regexp_extract(line, '^(\\d+)\\.(\\d+)\\s+(.+)', 3), '') AS section, coalesce(TRY_CAST(regexp_extract(line, '^(\\d+)\\.(\\d+)\\s+(.+)', 2) AS INTEGER), 0) AS section_number, list_transform(blocks, lambda b: coalesce(b.text, '')) AS texts FROM c WHERE asked AND len(blocks) > 0""")
def asked_pages(spark, d):
    """The pages a model is asked for, with the section in force and the texts it sees."""
    pages = page_model.carry_asked_section(layout.latest_scans(_t(spark, d, "ocr_pages")))
    asked = pages.where((F.size("blocks") > 0) & page_model.has_unit_words(F.col("blocks")))
    return asked.select(F.concat_ws("/", "doc_id", "page_id").alias("key"), "section", "section_number", F.transform(page_model.simple_blocks(F.col("blocks")), lambda b: b["text"]).alias("texts"))


def _answers(spark, d):
    """Answers as a model might give them, a fenced JSON array per page, made from the units of one method."""
    u = _side(spark, d, "llm").where("_page_id IS NOT NULL AND _doc_id IS NOT NULL")
    spans = F.transform("_formula_spans", lambda s: F.struct(s["text"].alias("text"), s["source_block"].alias("source_block")))
    item = F.struct(F.col("unit_id").alias("n"), F.lit("p999").alias("page_id"), F.upper("env").alias("unit_type"), F.col("label").alias("title"), F.col("content").alias("statement_text"), F.col("_source_blocks").alias("source_blocks"), F.reverse("_source_blocks").alias("reading_order"), (F.col("unit_index") % 7 / 5).alias("confidence_score"), spans.alias("formula_spans"))
    packed = u.groupBy(F.col("_doc_id").alias("doc_id"), F.col("_page_id").alias("page_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    raw = packed.select("doc_id", "page_id", F.concat(F.lit("Here it is:\n```json\n"), F.to_json("items"), F.lit("\n```")).alias("raw_output"), F.array().cast("array<int>").alias("candidate_source_blocks"))
    return postprocess.with_valid_ids(raw, _t(spark, d, "ocr_pages"))


_KEPT = "list_filter(sb, lambda x, i: list_contains(valid, x) AND list_position(sb, x) = i)"
_ANSWERED = f"""v AS (SELECT doc_id, page_id, list_distinct(flatten(list(list_transform(blocks, lambda b: b.block_id)))) AS valid FROM ocr_pages GROUP BY 1, 2),
a AS (SELECT _doc_id AS doc_id, _page_id AS page_id, row_number() OVER (PARTITION BY _doc_id, _page_id ORDER BY unit_id) AS seq, env, label, content, coalesce(_source_blocks, []) AS sb, unit_index, _formula_spans AS fs, coalesce(valid, []) AS valid FROM units LEFT JOIN v ON v.doc_id = _doc_id AND v.page_id = _page_id WHERE method = 'llm' AND _doc_id IS NOT NULL AND _page_id IS NOT NULL),
b AS (SELECT *, {_KEPT} AS source_blocks FROM a)"""


@query(f"""WITH {_ANSWERED}, o AS (SELECT doc_id, page_id, source_blocks, min(seq) AS seq FROM b WHERE len(source_blocks) > 0 GROUP BY 1, 2, 3) SELECT doc_id, page_id, printf('cand_%s_%02d', page_id, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY seq)) AS candidate_id, source_blocks FROM o""")
def answer_candidates(spark, d):
    return postprocess.stage1(_answers(spark, d))


@query(f"""WITH {_ANSWERED}, c AS (SELECT *, CASE lower(env) WHEN 'def' THEN 'definition' WHEN 'definition' THEN 'definition' WHEN 'thm' THEN 'theorem' WHEN 'theorem' THEN 'theorem' WHEN 'lem' THEN 'lemma' WHEN 'lemma' THEN 'lemma' WHEN 'prop' THEN 'proposition' WHEN 'proposition' THEN 'proposition' WHEN 'cor' THEN 'corollary' WHEN 'corollary' THEN 'corollary' WHEN 'ex' THEN 'example' WHEN 'example' THEN 'example' ELSE 'other' END AS unit_type,
 {_COLLAPSE('label')} AS title, {_COLLAPSE('content')} AS statement_text, list_filter(list_transform(coalesce(fs, []), lambda s, i: struct_pack(formula_id := printf('f_%s_%02d', page_id, i), text := {_COLLAPSE('s.text')}, source_block := s.source_block)), lambda s: s.text <> '' AND list_contains(valid, s.source_block)) AS formula_spans,
 round(least(unit_index % 7 / 5, 1), 4) AS confidence_score, list_filter(list_reverse(sb), lambda x, i: list_contains(valid, x) AND list_position(list_reverse(sb), x) = i) AS ro FROM b WHERE len(source_blocks) > 0),
e AS (SELECT *, CASE WHEN len(ro) > 0 AND len(list_filter(ro, lambda x: NOT list_contains(source_blocks, x))) = 0 THEN ro ELSE source_blocks END AS reading_order FROM c WHERE statement_text <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, page_id, source_blocks, unit_type, lower(statement_text) ORDER BY confidence_score DESC, seq) = 1)
SELECT doc_id, page_id, printf('pred_%s_%02d', page_id, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY source_blocks, seq)) AS unit_id, unit_type, title, statement_text, formula_spans, source_blocks, reading_order, confidence_score, '' AS notes FROM e""")
def answer_units(spark, d):
    return postprocess.stage2(_answers(spark, d))


@query()
def built_gold(spark, d):
    g = _side(spark, d, "gold").select("_doc_id", "unit_id", "label", "env", "content")
    return gold.built_gold(g, _blocks(spark, d))[0]
