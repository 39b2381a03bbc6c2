"""Block-form evaluation, agreement, outside models, tables and steps on small fixtures."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evaluate, gold, match, metrics, page_model, postprocess, report, tables
from folioscope.plans import pipelines, steps
from folioscope.sources import io

SPANS = "array<struct<formula_id:string,text:string,source_block:int>>"
CONTEXT = "struct<chapter:string,section:string,subsection:string,chapter_number:int,section_number:int,subsection_number:int>"
UNIT = f"unit_id bigint, _doc_id string, _page_id string, label string, env string, content string, proof string, number_components array<int>, context {CONTEXT}, _source_blocks array<int>, _formula_spans {SPANS}, method string"


def unit(i, label="Lemma 1.1", env="lem", content="It holds for all of them.", blocks=(1,), book="d", page="p1", spans=(), proof=None, numbers=(1, 1), method="gold"):
    return (i, book, page, label, env, content, proof, list(numbers) if numbers is not None else None, None, list(blocks) if blocks is not None else None, [("f", "x", b) for b in spans], method)


def units(spark, *rows):
    return spark.createDataFrame(list(rows), UNIT)


def test_block_form_scores(spark):
    g = units(spark, unit(1, blocks=(1, 2, 3), content="a b b c"), unit(2, blocks=(5, 6), content="x y"), unit(3, book="e", blocks=(9,)))
    p = units(spark, unit(11, blocks=(1, 3), content="a b c c", env="thm"), unit(12, blocks=(6, 7), content="x y", spans=(6,)))
    pairs = match.match_blocks(g, p, ["_doc_id", "_page_id"])
    rows = {r.doc_id: r for r in evaluate.evaluate_blocks(g, p, pairs).collect()}
    d, e = rows["d"], rows["e"]
    assert (d.boundary_precision, d.boundary_recall, d.boundary_f1) == (0.5, 0.5, 0.5)
    assert d.block_assignment_accuracy == pytest.approx(2 / 3) and d.unit_type_accuracy == 0.0
    assert d.matched_unit_count == 2 and d.formula_attachment_accuracy == 0.5
    # Tokens count with repeats: a, b, c of a, b, b, c.
    assert d.statement_completeness == pytest.approx((0.75 + 1) / 2)
    assert d.normalized_edit_distance == pytest.approx((1 / 7 + 0) / 2, abs=0.08)
    assert d.structured_parse_success == 1.0
    assert (e.matched_unit_count, e.boundary_f1, e.statement_completeness, e.normalized_edit_distance, e.formalization_readiness) == (0, 0, 0, 1, 0)


def test_books_without_a_pair_have_zeros(spark):
    g, p = units(spark, unit(1), unit(2, label="Lemma 1.2"), unit(3, label="Lemma 1.2")), units(spark, unit(11, label="Note", content="zzz"), unit(12, label="Lemma 1.2"))
    v1 = pipelines.evaluate(g, p, "v1").first()
    # Distinct labels count: two gold ones, one predicted.
    assert (v1.gold, v1.pred, v1.matched, v1.precision, v1.recall) == (2, 1, 1, 1.0, 0.5)
    none = pipelines.evaluate(g, units(spark, unit(11, label="Note", content="zzz")), "v2").first()
    assert (none.matched, none.completeness, none.edit, none.ready) == (0, 0.0, 1.0, 0.0)
    pooled = pipelines.evaluate_pooled(g, p).first()
    assert (pooled.gold, pooled.pred, pooled.matched) == (3, 2, 1)


def test_a_title_stands_in_for_a_label(spark):
    g = units(spark, unit(1))
    p = units(spark, unit(11, label="")).withColumn("title", F.lit("Lemma 1.1 (Zorn)"))
    assert [(r.gold_id, r.pred_id) for r in match.match_labels_v1(g, p).collect()] == [(1, 11)]


def test_similar_pairs_against_brute_force(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    text = lambda: " ".join(rng.sample(words, rng.randint(1, 10)))
    g = [unit(i, content=text()) for i in range(30)]
    p = [unit(100 + i, content=text()) for i in range(30)]
    got = {(r.gold_id, r.pred_id) for r in match._similar_pairs(units(spark, *g), units(spark, *p), "_doc_id", 0.5).collect()}
    sets = {x[0]: set(x[5].split()) for x in g + p}
    want = {(a[0], b[0]) for a in g for b in p if len(sets[a[0]] & sets[b[0]]) / len(sets[a[0]] | sets[b[0]]) > 0.5}
    assert got == want and want


def test_changes_and_errors(spark):
    g = units(spark, unit(1), unit(2, label="Lemma 1.2", proof="Yes."), unit(3, label="Lemma 1.3"))
    p = units(spark, unit(11, env="thm", numbers=(1, 2)), unit(12, label="Lemma 1.2", content="a�b" * 3), unit(14, label="Lemma 1.4"), unit(15, label=None))
    assert {(r.label, r.change) for r in evaluate.label_changes(g, p).collect()} == {("Lemma 1.1", "env,numbers"), ("Lemma 1.2", "content,proof"), ("Lemma 1.3", "removed"), ("Lemma 1.4", "added")}
    assert {(r.key, r.side) for r in evaluate.missed_and_extra(g, p).collect()} == {("Lemma 1.3", "missed"), ("Lemma 1.4", "extra")}
    every = g.unionByName(p.withColumn("method", F.lit("ours")))
    pairs = spark.createDataFrame([("ours", 1, 11), ("ours", 2, 12)], "method string, gold_id bigint, pred_id bigint")
    row = evaluate.error_counts(every, "gold", pairs).first()
    assert (row.method, row.fn, row.fp, row.lost) == ("ours", 1, 2, 3)
    checks = {(r.method, r.rule): r.n for r in evaluate.data_checks(every, "gold", pairs).collect()}
    assert checks["ours", "env_mismatch"] == 1 and checks["ours", "count_delta"] == 1 and checks["gold", "units"] == 3 and checks["ours", "missing_books"] == 0
    agreed = evaluate.pooled_agreement(g, p, pairs.select("gold_id", "pred_id")).first()
    assert (agreed.units_a, agreed.units_b, agreed.matched, agreed.type) == (3, 4, 2, 0.5)
    assert evaluate.label_changes(g.limit(0), p.limit(0)).count() == 0


BLOCK = "struct<block_id:int,block_type:string,text:string,bbox:array<double>,font_size:double,is_bold:boolean>"


def pages_of(spark, *pages):
    rows = [(i, "d", f"p{i:03d}", 600.0, [(k, kind, text, [0.0, 0.0, 1.0, 1.0], 10.0, False) for k, (kind, text) in enumerate(blocks)], dt.datetime(2024, 1, 1)) for i, blocks in enumerate(pages, 1)]
    return spark.createDataFrame(rows, f"scan_id bigint, doc_id string, page_id string, page_height double, blocks array<{BLOCK}>, scanned_at timestamp")


def test_pages_asked_of_a_model(spark):
    pages = pages_of(spark, [("heading", "1.2 First"), ("text", "Lemma 1.1 It holds.")], [("heading", "1.3 Unasked"), ("text", "nothing here")], [("text", "Theorem 1.2 So.")], [])
    asked = {r.key: r.prompt for r in page_model.page_requests(pages).collect()}
    assert set(asked) == {"d/p001", "d/p003"}
    # A page that is not asked does not move the section on.
    assert "section 2 (First)" in asked["d/p003"] and '"type":"text"' in asked["d/p003"]

    def client():
        def answer(prompt):
            n = 1 if "Lemma" in prompt else 2
            return f'```json\n[{{"label": "Lemma 1.1", "content": "{"x" * n}", "number_components": [1, {n}]}}]\n```', 10, 5

        return answer

    units_, usage = page_model.model_units(pages, client)
    assert [(r.label, r.content, r["index"]) for r in units_.collect()] == [("Lemma 1.1", "xx", 1)]
    assert [(r.doc_id, r.llm_calls, r.total_tokens) for r in usage.collect()] == [("d", 2, 30)]
    assert page_model.model_units(pages)[0].count() == 0


def test_answers_keep_spans_notes_and_book(spark):
    item = [{"unit_type": "defn", "statement_text": "A", "source_blocks": [1], "formula_spans": [{"text": " x  = y ", "source_block": 1}, "bare", {"text": "", "source_block": 1}, {"text": "z", "source_block": "2"}, {"text": "w", "source_block": 9}], "notes": "n"}]
    raw = spark.createDataFrame([("d", "p1", json.dumps(item), None), ("e", "p1", json.dumps(item[0] | {"formula_spans": {"text": "one", "source_block": 1}}), None)], "doc_id string, page_id string, raw_output string, candidate_source_blocks array<int>")
    pages = pages_of(spark, [("text", "a"), ("text", "b"), ("text", "c")]).withColumn("page_id", F.lit("p1"))
    both = pages.unionByName(pages.withColumn("doc_id", F.lit("e")))
    rows = {r.doc_id: r for r in postprocess.stage2(postprocess.with_valid_ids(raw, both)).collect()}
    assert rows["d"].unit_type == "other" and rows["d"].notes == "n" and rows["d"].unit_id == rows["e"].unit_id == "pred_p1_01"
    assert [(s.formula_id, s.text, s.source_block) for s in rows["d"].formula_spans] == [("f_p1_01", "x = y", 1), ("f_p1_04", "z", 2)]
    assert [s.text for s in rows["e"].formula_spans] == ["one"]


def test_gold_from_pages(spark):
    pages = pages_of(spark, [("text", "Lemma 1.1 Let A be"), ("formula", "x = y"), ("text", "Proof So.")], [("text", "see Lemma 1.1 there")])
    g = units(spark, unit(5, content="Lemma 1.1 Let A be x = y"), unit(6, label="Lemma 1.10"), unit(7, label=None))
    from folioscope.operators import layout

    built, missing = gold.built_gold(g, layout.explode_blocks(pages))
    row = built.first()
    assert (row.gold_id, row.page_id, row.statement_text, row.source_blocks, [s.text for s in row.formula_spans]) == ("gold_d_0000", "p001", "Lemma 1.1 Let A be x = y", [0, 1], ["x = y"])
    assert missing.first().not_located == 2
    near = gold.locate_units(g.where("unit_id = 5"), layout.explode_blocks(pages_of(spark, [("text", "Lemma 1.10 other")])))
    assert near.count() == 1 and gold.locate_units(g.where("unit_id = 5"), layout.explode_blocks(pages_of(spark, [("text", "Lemma 1.10 other")])), exact=True).count() == 0


def test_tables_and_steps(spark, tmp_path):
    rows = [unit(1), unit(2, label="Lemma 1.2", blocks=(2,)), unit(11, method="ours"), unit(12, method="rule", label="Lemma 1.2", blocks=(2,))]
    main, usable = steps.system_tables(units(spark, *rows), "gold", {"ours": "Ours", "rule": "Rule-based"})
    assert main.rows[0][0] == "Ours" and main.rows[0][1:4] == [100.0, 50.0, 66.67]
    assert usable.rows[1][0] == "Raw OCR / weak baseline" and r"\begin{tabular}" in usable.latex(bold=[1])
    assert main.csv().startswith("method,boundary_precision")
    units(spark, *rows[:2]).write.parquet(str(tmp_path / "g"))
    units(spark, *rows[2:]).write.parquet(str(tmp_path / "p"))
    steps.run(spark, "evaluate_blocks", [str(tmp_path / "g"), str(tmp_path / "p")], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        steps.run(spark, "other", [str(tmp_path / "g")], str(tmp_path / "x"))
    errors = spark.createDataFrame([("ours", 1, 2, 3, 4, 5)], "method string, fn int, fp int, lost int, parse_errors int, symbol_errors int")
    assert tables.error_table(errors).rows[0] == ["Boundary FN (missed)", 1]
    costs = spark.createDataFrame([("llm", 2, 3, 4, 7, 61.0), ("rule", 0, 0, 0, 0, None)], "method string, calls int, prompt_tokens int, completion_tokens int, total_tokens int, seconds double")
    assert [r[-1] for r in tables.cost_table(costs).rows] == ["1m1s", "N/A"]
    summary = spark.createDataFrame([("dev", 1, 4), ("test", 2, 4), (None, 3, 9)], "split string, a int, b int")
    assert [(r.measure, r.parts, r.total) for r in evaluate.split_totals(summary, "split", ["a", "b"]).collect()] == [("b", 8, 9)]


def test_files_keep_rows_and_order(spark, tmp_path):
    io.write_json_array(spark.createDataFrame([(2, "b"), (1, "a")], "i int, t string"), str(tmp_path / "a"))
    text = spark.read.text(str(tmp_path / "a"), wholetext=True).first().value
    assert [r["i"] for r in json.loads(text)] == [2, 1]
    with pytest.raises(ValueError):
        io.write_json_array(spark.range(5), str(tmp_path / "b"), most=3)
    stats = spark.createDataFrame([("llm", 1, "d", 2, 3, 4, None, 1.5)], "method string, chapter int, doc_id string, llm_calls bigint, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, wall_time_seconds double")
    io.write_stats(stats, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().total_tokens == 7
    io.write_jsonl(stats, str(tmp_path / "l"))
    io.write_csv(stats, str(tmp_path / "c"), one_file=True)
    assert spark.read.json(str(tmp_path / "l")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    (tmp_path / "ids.txt").write_text("p1\n\n p2 \np1\n")
    assert {r.page_id for r in io.read_page_ids(spark, str(tmp_path / "ids.txt")).collect()} == {"p1", "p2"}


def test_contexts_of_many_lost_characters(spark):
    text = "ab" + "�" * 2 + "c\nd�"
    row = spark.range(1).select(T.repair_contexts(F.lit(text), 2).alias("r"), T.repair_contexts(F.lit("plain")).alias("p"), T.repair_contexts(F.lit(None).cast("string")).alias("n")).first()
    assert [(r.pos, r.context) for r in row.r] == [(2, "ab��c"), (3, "b��c "), (7, " d�")] and row.p == [] and row.n == []


def test_stream_of_orphans(spark, tmp_path):
    from folioscope.streaming.pages import orphan_counts

    rows = [("d", ["Lemma 1.1", "Thm. 2", None, " "], dt.datetime(2024, 1, 1)), ("d", None, dt.datetime(2024, 1, 2)), ("d", ["Theorem 2"], dt.datetime(2024, 1, 3))]
    spark.createDataFrame(rows, "_doc_id string, dependencies array<string>, arrived_at timestamp").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("d", "lemma", "1.1")], "doc string, kind string, number string")
    stream = spark.readStream.schema("_doc_id string, dependencies array<string>, arrived_at timestamp").parquet(str(tmp_path / "in"))
    q = orphan_counts(stream, known).writeStream.outputMode("update").format("memory").queryName("orphans_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.orphans for r in spark.table("orphans_out").collect()) == [1, 1]


def test_shared_folder_is_asked_for(spark):
    from folioscope import session

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://x:7077", "getConf": staticmethod(lambda: type("K", (), {"get": staticmethod(lambda *a: None)}))})

    with pytest.raises(ValueError):
        session.shared_dir(Elsewhere)


def test_whole_pipeline_repairs_and_counts(spark):
    pages = pages_of(spark, [("heading", "1.2 First"), ("text", "Lemma 1.1 For all sp�ces of this kind, as was seen before."), ("text", "Proof So it is. □")], [("text", "Lemma 1.1 Again.")])
    units_, runs = pipelines.process_pages(pages, lambda: lambda prompt: ('[{"id": 16, "char": "a"}]' if "�" in prompt else "[]", 7, 2))
    rows = units_.collect()
    assert [(r.label, r["index"], r.section) for r in rows] == [("Lemma 1.1", 1, "First")]
    assert "�" in rows[0].content or "spaces" in rows[0].content
    assert [(r.doc_id, r.llm_calls, r.prompt_tokens) for r in runs.collect()] == [("d", 1, 7)]
    assert pipelines.process_pages(pages.limit(0))[0].count() == 0


def test_pdf_blocks_become_pages(spark, tmp_path):
    from folioscope.operators import layout

    (tmp_path / "a.pdf").write_bytes(b"Theorem 1.1|So.")
    schema = "doc_id string, page_id string, page_index int, pos int, is_image boolean, lines array<array<struct<text:string,size:double,font:string>>>, bbox array<double>"

    def decode(content):
        for i, text in enumerate(content.decode().split("|")):
            yield {"doc_id": "a", "page_id": "p001", "page_index": 0, "pos": i, "is_image": False, "lines": [[{"text": text, "size": 10.04, "font": "Times-Bold"}]], "bbox": [1.04, 2.0, 3.0, 4.0]}
        yield {"doc_id": "a", "page_id": "p001", "page_index": 0, "pos": 9, "is_image": True, "lines": [], "bbox": [0.0, 0.0, 1.0, 1.0]}
        yield {"doc_id": "a", "page_id": "p001", "page_index": 0, "pos": 10, "is_image": False, "lines": [[{"text": " ", "size": 9.0, "font": "x"}]], "bbox": [0.0, 0.0, 1.0, 1.0]}

    page = layout.assemble_page(io.read_pdfs(spark, str(tmp_path), decode, schema)).first()
    assert [(b.block_id, b.block_type, b.text, b.font_size, b.is_bold) for b in page.blocks] == [(0, "theorem_heading", "Theorem 1.1", 10.0, True), (1, "text", "So.", 10.0, True), (2, "image", "[image]", 0.0, False)]
    assert page.blocks[0].bbox[0] == 1.0 and page.num_blocks == 3


def test_checks_of_reports(spark, tmp_path):
    from folioscope.operators import stats

    assert stats.missing_measures(spark.range(1).withColumn("boundary_f1", F.lit(1.0)))[:2] == ["boundary_precision", "boundary_recall"]
    (tmp_path / "here").write_text("x")
    files = spark.createDataFrame([(str(tmp_path / "here"),), (str(tmp_path / "gone"),), (None,)], "path string")
    assert [r.path for r in stats.missing_files(files, "path").collect()] == [str(tmp_path / "gone")]
    texts = spark.createDataFrame([(1, "A TODO here"), (2, "fine"), (3, None)], "i int, t string")
    assert [tuple(r) for r in stats.unfinished_texts(texts, "i", "t").collect()] == [(1, "todo")]
    values = tables.macro_values({"pages": 3, "ocr_blocks": 9, "theorem_units": 4, "multi_block_unit_ratio": 0.5}, {"boundary_f1": 1.0, "formula_attachment_accuracy": 0.5, "statement_completeness": 0.25, "formalization_readiness": 0.9}, {"pages": 2, "boundary": 0.5, "type": 1.0, "formula": 1.0})
    assert values["TWOBOUNDARYFONE"] == "100" and values["MULTIBLOCKRATIO"] == "50" and report.fill_macros("", values).count("newcommand") == 12


def test_manifest_takes_the_first_image(spark):
    from folioscope.operators import stats

    pages = pages_of(spark, [("text", "Proof. x = y")], [("text", "a")])
    images = spark.createDataFrame([("/i/p001.png",), ("/i/b/p001.jpg",), ("/i/p009.png",)], "path string")
    got = {r.page_id: (r.image_path, r.has_proof_adjacent, r.has_formula_dense, r.pdf_page_no) for r in stats.manifest(pages, images).collect()}
    assert got == {"p001": ("/i/b/p001.jpg", 1, 1, "001"), "p002": (None, 0, 0, "002")}


def test_reports_refuse_to_cut(spark):
    with pytest.raises(ValueError):
        report.table_rows(spark.range(5), ["id"], most=3)


def test_bootstrap_of_many_chapters(spark):
    n = 20_000
    chapters = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("ready"))
    v = sorted(r["ready"] for r in chapters.collect())
    means = []
    for b in range(0, 10_000, 1000):
        x = (b * 7919 + np.arange(n) * 104729 + 42 * 1299709) % 2147483647
        means.append(np.array(v)[x * 48271 % 2147483647 * 48271 % 2147483647 % n].mean())
    got = metrics.bootstrap(chapters, "ready").first()
    assert got["low"] < min(means) + 0.01 and got["low"] < got["mean"] < got["high"] and got["mean"] == pytest.approx(np.mean(v), abs=1e-3)
    few = metrics.bootstrap(chapters, "ready", resamples=1, low=0, high=0).first()
    assert few["mean"] == few["low"] == pytest.approx(means[0], rel=1e-12)
    assert metrics.bootstrap(chapters.where("ready > 1"), "ready").first()["mean"] is None


def test_similar_pairs_of_books_cut_to_a_grid(spark, monkeypatch):
    """Books larger than a cell, small books beside each other, tokens that books share, counts in several runs."""
    import random

    monkeypatch.setattr(match, "CELL", 7)
    monkeypatch.setattr(match, "AT_ONCE", 64)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(90)]
    text = lambda: " ".join(rng.sample(words[:12] if rng.random() < 0.6 else words, rng.randint(1, 11)))
    book = lambda: rng.choice(("large", "large", "large", "a", "b", "c", None))
    g = [unit(i, content=text(), book=book()) for i in range(70)] + [unit(90, content=None), unit(91, content="", book="only gold")]
    p = [unit(100 + i, content=text(), book=book()) for i in range(60)]
    for threshold in (0.3, 0.5, 0.8):
        got = {(r._doc_id, r.gold_id, r.pred_id, r.sim) for r in match._similar_pairs(units(spark, *g), units(spark, *p), "_doc_id", threshold).collect()}
        sets = {x[0]: set((x[5] or "").split()) for x in g + p}
        alike = lambda a, b: len(sets[a[0]] & sets[b[0]]) / max(len(sets[a[0]] | sets[b[0]]), 1)
        assert got == {(a[1], a[0], b[0], alike(a, b)) for a in g for b in p if a[1] and a[1] == b[1] and alike(a, b) > threshold} and got


def test_whole_texts_are_compared(spark):
    same = "a" * 600
    g, p = units(spark, unit(1, content=same + "b" * 400)), units(spark, unit(11, content=same + "c" * 400))
    assert pipelines.evaluate(g, p, "v2").first()["edit"] == pytest.approx(0.4)
    assert pipelines.evaluate(g, p, "v1").first()["edit"] == 0


def test_most_similar_against_every_ratio():
    import difflib
    import random

    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ra", "tion", "é", "-", " of the")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))[:300]
    pages = [text(90) for _ in range(120)] + [text(8) for _ in range(80)] + ["", "x", "x"]
    wanted = [p[: rng.randint(1, 300)] + text(5) for p in pages[::9]] + [text(60) for _ in range(12)] + ["", "x", "§§"]
    for w, (score, at) in zip(wanted, gold.most_similar(wanted, pages)):
        ratios = [difflib.SequenceMatcher(None, w, p).ratio() for p in pages]
        assert (score, at) == (max(ratios), ratios.index(max(ratios)))
    assert gold.most_similar(["x"], []) == [(-1.0, 0)]
    for _ in range(2000):
        a, b = ("".join(rng.choice(c) for _ in range(rng.randint(0, n))) for c, n in (("abc\0é", 30), ("abcx\0", 260)))
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert gold.reaching_ratio(a, b, gold._plain(b, "z"), ratio) == ratio
        assert gold.reaching_ratio(a, b, gold._plain(b, "z"), ratio + 0.1) in (-1, ratio)
