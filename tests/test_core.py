"""Hand-traced fixtures and properties of the core operators."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import scores as S
from folioscope.functions import text as T
from folioscope.functions.labels import canonical_number, parse_kind
from folioscope.operators import dedup, layout, match, metrics, orphans, postprocess, repair, report, segment, stats
from folioscope.sources import io

BLOCK = "struct<block_id:int,block_type:string,text:string,bbox:array<double>,font_size:double,is_bold:boolean>"
PAGE = f"scan_id bigint, doc_id string, page_id string, page_height double, num_blocks int, blocks array<{BLOCK}>"


def block(i, kind, text, box, font=10.0):
    return (i, kind, text, [float(x) for x in box], font, False)


@pytest.fixture(scope="module")
def page(spark):
    blocks = [
        block(0, "text", "7", (50, 20, 60, 30), 8.0),
        block(1, "text", "2 1 Basic Notions", (50, 22, 200, 32), 8.0),
        block(2, "heading", "1.2 Set Functions", (50, 60, 250, 76), 14.0),
        block(3, "theorem_heading", "Definition 1.1 A set A is closed if", (50, 100, 400, 112)),
        block(4, "formula", "x = y", (60, 114, 120, 124)),
        block(5, "text", "for all x in the whole space of points considered here and beyond.", (50, 140, 400, 152)),
        block(6, "theorem_heading", "Proof Take any x.", (50, 170, 400, 182)),
        block(7, "text", "Then it holds. □", (50, 200, 400, 212)),
        block(8, "text", "Some exposition after.", (50, 240, 400, 252)),
        block(9, "theorem_heading", "Remark 1.2 (Note) Fine.", (50, 280, 400, 292)),
        block(10, "text", "© Publisher 2020", (50, 560, 300, 570), 8.0),
    ]
    return spark.createDataFrame([(1, "d", "p001", 600.0, 11, blocks)], PAGE)


def test_segmentation_of_a_page(page):
    first, second = segment.extract_units(layout.explode_blocks(page)).orderBy("unit_index").collect()
    assert (first.label, first.env, first.number_components) == ("Definition 1.1", "def", [1, 1])
    assert (first.source_blocks, first.proof_blocks) == ([3, 4, 5], [6, 7])
    assert first.proof == "Proof Take any x. Then it holds. □"
    assert [tuple(s) for s in first.formula_spans] == [("f_p001_01", "x = y", 4)]
    assert (first.section, first.section_number) == ("Set Functions", 2)
    assert (second.label, second.source_blocks) == ("Remark 1.2", [9, 10])


def test_normalised_page(page):
    row = layout.normalize_pages(page).first()
    assert row.num_blocks == 7 and [b.block_id for b in row.blocks] == list(range(7))
    merged = row.blocks[1]
    assert (merged.text, merged.block_type, merged.bbox) == ("Definition 1.1 A set A is closed if x = y", "formula", [50.0, 100.0, 400.0, 124.0])
    units = segment.extract_units(layout.explode_blocks(layout.normalize_pages(page))).orderBy("unit_index").collect()
    assert [(u.label, u.source_blocks, u.proof_blocks) for u in units] == [("Definition 1.1", [1, 2], [3, 4]), ("Remark 1.2", [6], [])]


def test_empty_and_null_pages(spark):
    pages = spark.createDataFrame([(1, "d", "p1", None, 0, []), (2, "d", "p2", None, 0, None)], PAGE)
    assert [r.num_blocks for r in layout.normalize_pages(pages).collect()] == [0, 0]
    assert segment.extract_units(layout.explode_blocks(pages)).count() == 0


def test_rows_hang_on_their_anchor(spark):
    blocks = [block(i, "text", "t", (x, y, x + 5, y + 5)) for i, (y, x) in enumerate([(10, 200), (17, 50), (19, 10), (40, 10)])]
    df = spark.createDataFrame([(1, "d", "p", 600.0, 4, blocks)], PAGE)
    out = df.select(layout.reading_order(F.col("blocks")).alias("b")).first().b
    assert [(b.bbox[1], b.bbox[0]) for b in out] == [(17, 50), (10, 200), (19, 10), (40, 10)]


UNIT = "unit_id bigint, _doc_id string, label string, env string, content string, _source_blocks array<int>, _page_id string"


def test_matching_by_label_then_wording(spark):
    gold = spark.createDataFrame([(1, "d", "Definition 1.1", "def", "x", [1], "p"), (2, "d", "Theorem 1.2", "thm", "zeta", [2], "p"), (3, "d", "", "thm", "alpha beta gamma delta", [3], "p")], UNIT)
    pred = spark.createDataFrame([(11, "d", "Definition 1.1", "def", "short", [1], "p"), (12, "d", "Definition 1.1 (b)", "def", "longer content", [2], "p"), (13, "d", "Note", "thm", "alpha beta gamma", [3], "p")], UNIT)
    found = {(r.gold_id, r.pred_id) for r in match.match_units(gold, pred).collect()}
    assert found == {(1, 12), (3, 13)}
    row = metrics.boundary_scores(match.match_units(gold, pred), gold, pred, ["_doc_id"]).first()
    assert row.precision == row.recall == row.f1 == pytest.approx(2 / 3)
    v1 = match.match_labels_v1(gold, pred).collect()
    assert sum(r.gold_id is not None for r in v1) == 2 and sum(r.pred_id is not None for r in v1) == 1


def test_matching_by_blocks(spark):
    gold = spark.createDataFrame([(1, "d", "", "def", "", [1, 2, 3], "p"), (2, "d", "", "def", "", [5, 6], "p")], UNIT)
    pred = spark.createDataFrame([(11, "d", "", "def", "", [1, 3], "p"), (12, "d", "", "def", "", [6, 7], "p")], UNIT)
    keys = ["_doc_id", "_page_id"]
    assert {(r.gold_id, r.pred_id) for r in match.block_pairs(gold, pred, keys).collect()} == {(1, 11)}
    assert {(r.gold_id, r.pred_id) for r in match.match_blocks(gold, pred, keys).collect()} == {(1, 11), (2, 12)}


def test_greedy_depends_on_order(spark):
    pairs = spark.createDataFrame([("c", 0, 1, 0.9), ("c", 0, 0, 0.6), ("c", 1, 1, 0.8), ("c", 2, 0, 0.7)], "block string, gold_id bigint, pred_id bigint, sim double")
    assert {(r.gold_id, r.pred_id) for r in match.greedy(pairs, "block").collect()} == {(0, 1), (2, 0)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.sampled_from([0.3, 0.6, 0.9])), max_size=12, unique_by=lambda x: x[:2]))
def test_greedy_against_a_plain_loop(spark, raw):
    pairs = spark.createDataFrame([("b", g, p, s) for g, p, s in raw], "block string, gold_id bigint, pred_id bigint, sim double")
    used, want = set(), set()
    for g in sorted({x[0] for x in raw}):
        for _, p in sorted((-s, p) for gg, p, s in raw if gg == g):
            if p not in used:
                used.add(p)
                want.add((g, p))
                break
    assert {(r.gold_id, r.pred_id) for r in match.greedy(pairs, "block").collect()} == want


def test_scorers(spark):
    df = spark.createDataFrame([("Theorem 5.", "thm", "ab", [5]), ("Lemma 1.1", "lem", "f(x", [1, 1]), ("Lemma 1.1", "lem", "(a]b", [1, 1]), ("Lemma 1.1", "lem", "a)b(", [1, 1])], "label string, env string, content string, n array<int>")
    c = F.col
    none = F.lit(None).cast("string")
    rows = df.select(S.v2_parse(c("label"), c("env"), c("content"), c("n")).alias("p"), S.v2_symbol(c("content"), none).alias("s"), S.v2_retrieval(c("label"), c("env"), c("content"), c("n"), none, F.lit(0)).alias("r"), S.v1_symbol(c("content"), F.array().cast("array<string>")).alias("s1")).collect()
    assert [round(r.s, 2) for r in rows] == [0.85, 0.6, 0.6, 0.6]
    assert [round(r.s1, 2) for r in rows] == [0.85, 0.5, 0.15, 0.5]
    assert (round(rows[0].p, 2), round(rows[0].r, 2)) == (0.85, 0.6)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("()[]{}ab", max_size=12))
def test_balance_against_a_stack(spark, text):
    stack, ok = [], True
    for ch in text:
        if ch in "([{":
            stack.append(")]}"["([{".index(ch)])
        elif ch in ")]}":
            ok = bool(stack) and stack.pop() == ch
            if not ok:
                break
    assert spark.range(1).select(T.balanced(F.lit(text)).alias("b")).first().b == (ok and not stack)


def test_repairs(spark):
    one = spark.range(1)
    fixed = one.select(T.apply_at(F.lit("a�b�"), F.create_map(F.lit(1), F.lit("∈"), F.lit(5), F.lit("x"))).alias("t")).first().t
    assert fixed == "a∈b�"
    edits = F.array(F.struct(F.lit("�").alias("find"), F.lit("∩").alias("replace")))
    row = one.select(T.apply_once(F.lit("x � y � z"), edits).alias("c"), T.apply_once(F.lit("�"), edits).alias("p")).first()
    assert (row.c.text, row.p.text, row.c.hits + row.p.hits) == ("x ∩ y � z", "∩", 2)
    spots = one.select(T.repair_contexts(F.lit("ab�cd")).alias("r"), T.repair_contexts(F.lit("")).alias("e")).first()
    assert [(r.pos, r.context) for r in spots.r] == [(2, "ab�cd")] and spots.e == []


def test_repair_requests_and_answers(spark):
    units = spark.createDataFrame([(1, "a�b", None), (2, "fine", "p�")], "unit_id bigint, content string, proof string")
    requests = repair.symbol_requests(units)
    assert {r.key for r in requests.collect()} == {"1/content", "2/proof"}
    answers = repair.ask(requests, lambda: lambda prompt: 'Sure: [{"id": 1, "char": "x"}]')
    out = {r.unit_id: (r.content, r.proof) for r in repair.apply_symbol_answers(units, answers).collect()}
    assert out == {1: ("axb", None), 2: ("fine", "px")}

    def failing():
        def call(prompt):
            raise OSError

        return call

    assert all(r.answer is None and r.attempts == 2 for r in repair.ask(requests, failing, tries=2, wait=0.0).collect())


RAW = "page_id string, raw_output string, candidate_source_blocks array<int>, valid_ids array<int>"


def test_candidates_from_an_answer(spark):
    raw = spark.createDataFrame([("p001", '```json\n[{"page_id":"p999","source_blocks":"3, 2;2 9"}]\n```', None, [1, 2, 3]), ("p002", "no json", None, [1])], RAW)
    assert [tuple(r) for r in postprocess.stage1(raw).collect()] == [("p001", "cand_p001_01", [3, 2])]


def test_validated_units(spark):
    answer = '{"units":[{"unit_type":"thm","statement_text":" A  b ","source_blocks":[2,1],"confidence_score":"0.4"},{"unit_type":"Theorem","statement_text":"a b","source_blocks":[2,1],"reading_order":[1],"confidence_score":2},{"statement_text":""}]}'
    rows = postprocess.stage2(spark.createDataFrame([("p1", answer, [1], [1, 2])], RAW)).collect()
    assert [(r.unit_id, r.unit_type, r.source_blocks, r.reading_order, r.confidence_score) for r in rows] == [("pred_p1_01", "theorem", [2, 1], [1], 1.0)]


def test_labels(spark):
    words = ["Thm. 1.60", "THEOREM  1.1.2 (i)", "Def 2.1.", "Lemma", None, "", "Section 3"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [(r.k, r.n) for r in df.select(parse_kind(F.col("w")).alias("k"), canonical_number(F.col("w")).alias("n")).collect()]
    assert got[:4] == [("theorem", "1.60"), ("theorem", "1.1.2"), ("definition", "2.1"), (None, None)]
    assert got[4] == (None, None) and got[6][0] is None


U = "unit_id bigint, _doc_id string, label string, dependencies array<string>, arrived_at timestamp, cause string"
W = "unit_id bigint, withdrawn_at timestamp"


def day(n):
    return dt.datetime(2024, 1, n)


def test_orphans_as_of_arrival(spark):
    units = spark.createDataFrame(
        [
            (1, "d", "Theorem 1.1", None, day(1), "clash"),
            (2, "d", "Lemma 1.2", ["thm. 1.1(a)", " ", None, "Lemma 9.9", "Def. 1.3"], day(2), "clash"),
            (3, "d", "Definition 1.3", ["Theorem 1.1"], day(5), None),
            (4, "e", None, ["Theorem 1.1", "Lemma 1.2"], day(5), None),
            (5, None, "Theorem 1.1", ["Theorem 7"], day(5), None),
            (6, "d", "Theorem 1.1", ["Theorem 1.1"], day(7), None),
        ],
        U,
    )
    gone = spark.createDataFrame([(1, day(4)), (1, day(3)), (99, day(1))], W)
    got = {(r.unit_id, r.dep_pos, r.cause) for r in orphans.orphan_citations(units, gone).collect()}
    assert got == {(2, 3, "missing"), (2, 4, "late"), (3, 0, "withdrawn"), (4, 0, "missing"), (4, 1, "missing")}
    report = orphans.orphan_report(units, gone).collect()
    assert [(r.month, r.citations, r.missing, r.late, r.withdrawn) for r in report] == [("2024-01", 7, 3, 1, 1)]


def test_orphans_of_empty_tables(spark):
    assert orphans.orphan_citations(spark.createDataFrame([], U), spark.createDataFrame([], W)).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9), st.integers(1, 3)), min_size=1, max_size=8))
def test_orphans_against_brute_force(spark, raw):
    rows = [(i, "d", f"Lemma {k}", [f"lem. {k % 3 + 1}"], day(a), None) for i, (a, _, k) in enumerate(raw)]
    gone = [(i, day(w)) for i, (_, w, _) in enumerate(raw) if w]
    want = set()
    for i, (a, _, k) in enumerate(raw):
        ps = [(b, w) for b, w, kk in raw if kk == k % 3 + 1]
        if not any(b <= a and (w == 0 or w > a) for b, w in ps):
            want.add((i, "missing" if not ps else "late" if all(b > a for b, _ in ps) else "withdrawn"))
    got = orphans.orphan_citations(spark.createDataFrame(rows, U), spark.createDataFrame(gone, W)).collect()
    assert {(r.unit_id, r.cause) for r in got} == want


def test_mock_predictions(spark):
    gold = spark.createDataFrame([(1, "x", [1, 2], [("f", "t", 1)]), (2, "y", [3], [])], "unit_id bigint, content string, _source_blocks array<int>, _formula_spans array<struct<formula_id:string,text:string,source_block:int>>")
    assert [r._source_blocks for r in stats.mock_predictions(gold, "truncate_blocks").collect()] == [[1], [3]]
    assert all(r._formula_spans == [] for r in stats.mock_predictions(gold, "drop_formulas").collect())
    assert stats.mock_predictions(gold, "copy_gold").collect() == gold.collect()
    with pytest.raises(ValueError):
        stats.mock_predictions(gold, "other")


def test_duplicates_and_numbers(spark):
    df = spark.createDataFrame([(1, "d", "A", "x", [1, 10]), (2, "d", "A", "long", [1, 2]), (3, "d", "", "y", None)], "unit_id bigint, _doc_id string, label string, content string, number_components array<int>")
    assert {r.unit_id for r in dedup.first_by_label(df).collect()} == {1, 3}
    assert {r.unit_id for r in dedup.longest_by_label(df, drop_blank=True).collect()} == {2}
    assert [r.unit_id for r in dedup.reindex(df).orderBy("new_index").collect()] == [3, 2, 1]


def test_reports():
    assert report.shown(2.50) == "2.5" and report.shown(None) == "-" and report.escaped("a_b&c") == r"a\_b\&c"
    assert report.bold_best([["a", 1.0], ["b", 2.0]], [1]) == [["a", "1"], ["b", r"\textbf{2}"]]
    assert r"\begin{tabular}{lc}" in report.latex_table(["m", "x"], [["a", 1.5]], "c", "t")
    assert report.fill_macros(r"\newcommand{\a}{1}", {"a": "2", "b": "3"}) == "\\newcommand{\\a}{2}\n\\newcommand{\\b}{3}\n"
    assert report.minutes(125.9) == "2m5s"


def test_files(spark, tmp_path):
    folder = tmp_path / "Chapter12"
    folder.mkdir()
    (folder / "p001.json").write_text('{"doc_id":"d","page_id":"p001","items":[{"block_id":0,"type":"text","text":"hi","bbox":[0,0,1,1],"font_size":9,"is_bold":false}]}')
    (folder / "manifest.json").write_text('{"doc_id":"d"}')
    rows = io.read_pages(spark, str(tmp_path)).collect()
    assert [(r.page_id, r.chapter, r.blocks[0].text) for r in rows] == [("p001", 12, "hi")]
    assert io.read_settings("A=1\n# c\nB='x'", {"A": "2"}) == {"A": "2", "B": "x"}
    io.write_json_array(spark.range(2), str(tmp_path / "out"))
    assert sum(1 for _ in (tmp_path / "out").iterdir()) >= 1


def test_annotations(spark):
    from folioscope.schemas import ANNOTATION

    rows = spark.createDataFrame([("done", "p1", "u1", "Theorem", "T", " a  b ", "", "1, 2;3", "", "x=y || z", "1 2", "", "", ""), ("skip", *[""] * 13), ("", "p1", "u2", "alien", "", "t", "", "1", "", "", "", "", "", "")], ANNOTATION)
    good = postprocess.annotation_units(rows, strict=False).collect()
    assert [(r.unit_id, r.unit_type, r.source_blocks, r.reading_order, [s.text for s in r.formula_spans]) for r in good] == [("u1", "theorem", [1, 2, 3], [1, 2, 3], ["x=y", "z"])]
    assert [r.unit_id for r in postprocess.annotation_rejects(rows).collect()] == ["u2"]
    with pytest.raises(Exception, match="unknown unit type"):
        postprocess.annotation_units(rows).collect()


def test_stream_of_pages(spark, page, tmp_path):
    from folioscope.streaming.pages import page_stream

    page.write.parquet(str(tmp_path / "in"))
    q = page_stream(spark, str(tmp_path / "in"), page.schema).writeStream.format("memory").queryName("pages_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pages_out").first().num_blocks == 7
