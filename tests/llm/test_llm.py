"""Text problems against brute force, planted cases, invariants and held-out accuracy."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import lexicon, lookalikes, markup, mixing, packing, scans, subjects, survivors, truncation


def texts(spark, rows):
    return spark.createDataFrame(rows, "unit_id bigint, content string, look string")


# --- look-alikes ----------------------------------------------------------------------------------


def test_same_look(spark):
    rows = [(1, "Let T be à free.", "x"), (2, "Lеt Т be à free.", "x"), (3, "Ｌet T be à fr​ee.", "x"), (4, "Let T be a free.", "x"), (5, "x² ∈ ℝ", None), (6, "x2 ∈ R", None), (7, "", None), (8, "​ ", None), (9, None, None), (10, "Let T be à free.", "x"), (11, "a b", None), (12, "a\nb", None)]
    got = {(r.unit_id_a, r.unit_id_b) for r in lookalikes.same_look_pairs(texts(spark, rows)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 10), (3, 10)}
    assert lookalikes.same_look_pairs(texts(spark, [])).count() == 0
    members = {r.unit_id: (r.class_id, r.form_id, r.forms, r.records) for r in lookalikes.same_look_members(texts(spark, rows)).collect()}
    assert members == {1: (1, 1, 3, 4), 2: (1, 2, 3, 4), 3: (1, 3, 3, 4), 10: (1, 1, 3, 4)}
    forms = {r.unit_id: r.canonical for r in lookalikes.canonical_text(texts(spark, rows), "unit_id", "content").collect()}
    assert forms[1] == forms[2] == forms[3] and forms[9] is None and forms[5] != forms[6]


# --- markup ---------------------------------------------------------------------------------------

SAMPLES = {
    "<p>Let <b>the</b> space be &lt; 3.</p>": {"html"},
    "# Title\n\n- an item here\n- other item here\n\nUse `f(x)`.": {"markdown"},
    "== Title ==\nSee [[Lemma 1|the lemma]] and '''this'''.": {"wiki"},
    "Put $x_{1} \\in A$ and \\emph{so} on.": {"latex"},
    "f * g * h = 4 and v_n < 3 < v_m, |K| = 2, { x | x > 3 }, #W = 5": set(),
    "u1 + u2 + ...\n+ un = 9 for all\n> 3 } and\n* h = 2": set(),
    "It costs $5 or $6 each.": set(),
}


def test_families_by_path_votes(spark):
    rows = [("h", i, t) for i, t in enumerate(SAMPLES)] + [("h", 100, None), ("h", 101, "")]
    df = spark.createDataFrame(rows, "host string, id bigint, text string")
    got = {}
    for r in markup.markup_families(df).collect():
        got.setdefault(r.id, set()).add(r.family)
    assert {i: got.get(i, set()) for i in range(len(SAMPLES))} == dict(enumerate(SAMPLES.values()))


def test_the_host_vote_decides(spark):
    """A quote without words is markup where the host quotes, and none where its lines are wrapped formulas."""
    quoting = [("a", i, "So.\n\n> A quoted line of plain words.") for i in range(20)] + [("a", 50, "So.\n\n> x = 3 +\n> y")]
    wrapping = [("b", 100 + i, "it holds.\n> 3 + x, <\n> 7") for i in range(20)]
    df = spark.createDataFrame(quoting + wrapping, "host string, id bigint, text string")
    found = {r.id for r in markup.markup_families(df).collect()}
    alone = {r.id for r in markup.markup_families(df, votes=False).collect()}
    assert found == {*range(20), 50} and alone == {*range(20)}
    clean = {r.id: r.clean for r in markup.clean_texts(df).collect()}
    assert clean[50] == "So.\n\nx = 3 +\ny" and clean[100] == "it holds.\n> 3 + x, <\n> 7"


def test_clean_text_keeps_structure(spark):
    clean = markup.clean_text("<h3>Title</h3>\n<ul><li>one two</li></ul><pre><code>x &lt; 1</code></pre>\\[ a = b \\] [[A|b]] **c**")
    assert "# Title" in clean and "- one two" in clean and "```\nx < 1\n```" in clean and "$ a = b $" in clean and "b c" in clean
    assert markup.clean_text(None) is None and markup.clean_text("") == ""
    plain = "f * g * h = 4 and v_n < 3 < v_m"
    assert markup.clean_text(plain) == plain
    df = spark.createDataFrame([("h", 1, "x"), (None, 2, "<b>y</b>"), ("h", 3, None)], "host string, id bigint, text string")
    assert {r.id: r.clean for r in markup.clean_texts(df).collect()} == {1: "x", 2: "y", 3: None}


def test_filter_drops_no_container(spark):
    rng = random.Random(5)
    parts = ["word", "x", " ", "  ", "\n", "\n", "\t", "\xa0", "\u0663", "1", ".", ")", "(", "|", "---", "--", ":", "===", "=", "#", "+", "-", "*", "*w", "_", "_v", ">", "<", "/b", "&#\u0663;", "&", "lt;", "'", "~", "`", "[", "]", "{", "}", "!", "\\", "$", "é"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    made += ["| n | value |\n|---|---|\n| 1 | 68 |", "n | value\n--- | :---:\n1 | 68", "so (*well known*) it is", "so (_well known_), it is", "\u0663. an item"]
    df = spark.createDataFrame(list(enumerate(made)), "id int, text string")
    dropped = [r.text for r in df.where(~df.text.rlike(markup.CANDIDATE)).collect()]
    assert len(dropped) > 500 and [t for t in dropped if markup.containers(t)] == []
    table = spark.createDataFrame([("h", 1, made[6000])], "host string, id bigint, text string")
    assert [tuple(r) for r in markup.markup_families(table).collect()] == [(1, "markdown")]
    assert markup.clean_texts(table).first().clean == "n | value\n1 | 68"


def test_lost_paths_are_left_alone(spark):
    wrapped = "the least m for which n\n> every bound of M"
    cases = {
        "quote.loose": (wrapped, wrapped),
        "quote": ("So.\n\n> A quoted line of words.", "So.\n\n> A quoted line of words."),
        "heading": ("# Title\n\n**b** it", "# Title\n\nb it"),
        "setext": ("Title\n---\nthe <b>text</b>", "Title\n---\nthe text"),
        "table": ("| n | v |\n|---|---|\n| 1 | 68 |", "| n | v |\n|---|---|\n| 1 | 68 |"),
        "link": ("see [**the** text](u) here", "see [the text](u) here"),
        "bold": ("a **b** and `c`", "a **b** and `c`"),
        "item.-.fresh.task": ("- [x] done work here", "- [x] done work here"),
    }
    for path, (text, want) in cases.items():
        assert markup.clean_text(text, frozenset({f"markdown:{path}"})) == want, path
    assert markup.clean_text("== A title ==\n''b'' {{t|x}}", frozenset({"wiki:heading", "wiki:template"})) == "== A title ==\nb {{t|x}}"
    assert markup.clean_text("a <b>c</b> &lt; \\emph{d}", frozenset({"html:b", "html:entity", "latex:command"})) == "a <b>c</b> &lt; \\emph{d}"
    assert markup.clean_text("|K| = |L|\n\n<b>c</b>") == "|K| = |L|\n\nc"
    df = spark.createDataFrame([("h", 1, wrapped), (None, 2, wrapped)], "host string, id bigint, text string")
    assert [r.clean for r in markup.clean_texts(df).collect()] == [wrapped] * 2


# --- truncation -----------------------------------------------------------------------------------

TR = "unit_id bigint, _doc_id string, method string, label string, content string, number_components array<int>, f string"


def test_planted_cuts(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta space group kernel module".split()
    rows, want = [], set()
    for i in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + "."
        if i % 3 == 0 and len(text) > 120:
            text = text[:120]
            if not text.endswith("."):
                want.add((i, "content"))
        rows.append((i, "d", "m", "Lemma 1.2", text, [1, 2], None))
    df = spark.createDataFrame(rows, TR)
    assert {(r.unit_id, r.field_name) for r in truncation.cut_values(df).collect()} == want
    lengths = truncation.significant_lengths(truncation.field_values(df)).collect()
    assert {r.length for r in lengths} == {120}


def test_significant_lengths_judge_the_endings(spark):
    """Unpunctuated notes, never seen at the limit, are no cuts; without the test of the lengths they would be."""
    rng = random.Random(6)
    words = "alpha beta gamma delta space group kernel module".split()
    rows, want = [], set()
    for i in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))
        text += " = 7" if i % 10 == 0 else "."
        if i % 3 == 0 and len(text) > 120:
            text = text[:120]
            if text[-1].isalpha() or text[-1] == " ":
                want.add(i)
        rows.append((i, "d", "m", "Lemma 1.2", text, [1, 2], None))
    df = spark.createDataFrame(rows, TR)
    got = {r.unit_id for r in truncation.cut_values(df).collect()}
    plain = {r.unit_id for r in truncation.cut_values(df, hazards=False).collect()}
    notes = {i for i in range(0, 3000, 10) if rows[i][4].endswith(" = 7")}
    assert want <= got and not (notes - want) & got and notes - want <= plain


def test_endings(spark):
    cases = [("Theor", "It holds.", True, False), ("Theorem 1.", "the relation is: x² + y² = 4", True, False), ("Theorem 1.2.", "the sum y1 + y2 + ...", False, True), ("Remark", "It holds for ea…", False, True), ("Lemma 1.2 (Zorn", "It holds. ∎", True, False), (None, None, False, False), (" ", "", False, False), ("Lem. 1.2 (Zorn)", "<p>So.</p>", False, False), ("Def. 1.2", "whenever 0 < x", False, True)]
    rows = [(i, "d", None, lab, con, [1, 2] if lab and any(c.isdigit() for c in lab) or lab == "Theor" else None, None) for i, (lab, con, _, _) in enumerate(cases)]
    got = {(r.unit_id, r.field_name) for r in truncation.cut_values(spark.createDataFrame(rows, TR)).collect()}
    want = {(i, "label") for i, c in enumerate(cases) if c[2]} | {(i, "content") for i, c in enumerate(cases) if c[3]}
    assert got == want
    assert truncation.cut_values(spark.createDataFrame([], TR)).count() == 0


def test_long_last_pieces(spark):
    row, link = "| n | " + "value " * 100 + "|", "[see](http://a.b/" + "c" * 500 + ")"
    cases = [("n\n---\n" + row, False), ("It is in " + link, False), ("x | " + "value " * 100 + "|", True), ("A rule\n" + "=" * 500, False), (f"{link}\nthen every spa", True), ("Title\n---\nthen every spa", True), (row + "\nthen every spa", True)]
    got = {(r.unit_id, r.field_name) for r in truncation.cut_values(spark.createDataFrame([(i, "d", None, "Lemma 1.2", c, [1, 2], None) for i, (c, _) in enumerate(cases)], TR)).collect()}
    assert got == {(i, "content") for i, (_, cut) in enumerate(cases) if cut}


# --- scans ----------------------------------------------------------------------------------------


def labels_of(model, text):
    return [scans.STATES[x] for x in model.label(scans.Lines(pa.array([text])))]


def test_lines_of_a_scan():
    model = scans.train()
    text = "For the follow-\n12  ELEMENTS OF LOGIC\n[12]\ning space we\nhave more."
    assert labels_of(model, text) == ["break", "header", "page_number", "body", "body"]
    assert labels_of(model, "One bare line\nbreak is none.") == ["body", "body"]
    lines = scans.Lines(pa.array([text]))
    assert list(scans._splits(lines, model.label(lines))) == [(0, "follow-ing")]
    fixed = scans.reassemble((text + "\n\n- item thc").split("\n"), [1, 2, 3, 0, 0, 0, 0], {"thc": "the"}, {"follow-ing"})
    assert fixed == "For the following space we have more.\n\n- item the"
    assert scans.reassemble(["well-", "founded sets"], [1, 0], {}, set()) == "well-founded sets"


def test_the_line_model_decides():
    """The same line has another label in another context, which no pattern of a single line can give."""
    model = scans.train()
    assert labels_of(model, "we have x² + y² =\n12") == ["body", "body"]
    assert labels_of(model, "we have the space\n12") == ["body", "page_number"]
    # Flat chances make the labels depend on single lines alone.
    model.gain[:] = 0.0
    model.base[:] = 0.0
    assert "page_number" not in labels_of(model, "we have the space\n12")


def test_training_learns_the_corpus():
    """Running heads of a look the examples don't have are learned from blocks at the page's edge."""
    rng = random.Random(8)
    heads = [f"Annales Tom {rng.randint(1, 60)} Livre" for _ in range(80)]
    body = ["the following holds for every space of this kind and so on"] * 300
    texts, place = heads + body, [scans.EDGE] * 80 + [scans.READING] * 300
    model = scans.train(pa.array(texts), np.array(place))
    got = model.label(scans.Lines(pa.array(texts)), np.array(place))
    assert (got[:80] >= scans.HEADER).all() and (got[80:] < scans.HEADER).all()


def test_all_texts_train_the_line_model(spark):
    """The model of a large corpus is that of all its texts, not of some: each look counts as often as it occurs."""
    kinds = ["for every space we have a set {}", "Notes on Analysis | {}", "[{}]", "let it be con-\n  \n{}  NOTES ON LOGIC\ntinuous in case {}", "we have x =\n{}", "\n- {} is of use.\nAnd so on", "Annales Tom {} Livre"]
    rng = random.Random(2)
    rows = [("unit", i, -1, rng.choice(kinds).replace("{}", str(rng.randint(1, 300))), rng.randint(0, 3)) for i in range(25_000)]
    rows += [("unit", 25_000, -1, "a line of plain words\nXII\n" * 3_000, scans.EDGE), ("unit", 25_001, -1, "§ 4 ∎", scans.READING)]
    df = spark.createDataFrame(rows, "kind string, id bigint, block_id int, text string, place int").repartition(5)
    got, want = scans.learn_lines(df), scans.train(pa.array([r[3] for r in rows]), np.array([r[4] for r in rows]))
    for name in ("base", "gain", "move", "first"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name


def test_the_examples_do_not_fade(monkeypatch):
    """A corpus three times as large, of the same texts, gives the same model."""
    monkeypatch.setattr(scans, "MASS", 50)
    texts, place = ["[3]", "Notes on Analysis | 12", "for every con-\n12\ntinuous map", "a line of plain words"] * 20, [scans.EDGE, scans.EDGE, scans.READING, scans.READING] * 20
    one, three = (scans.train(pa.array(texts * k), np.array(place * k)) for k in (1, 3))
    assert np.allclose(one.gain, three.gain) and np.allclose(one.move, three.move) and np.allclose(one.first, three.first)


def brute_meant(word, n, ordinary, ratio=20.0):
    """What a misread word means, by trying every ordinary word."""
    lost = word.count(lexicon.LOST)
    digits = any(c.isdigit() for c in word)
    if len(word) - lost < 2:
        return None
    if lost > 1:
        fit = [(0, m, o) for o, m in ordinary.items() if len(o) == len(word) and (s := lexicon.undone(word, o)) is not None and all(a in (b, lexicon.LOST) or a.isdigit() for a, b in zip(word, o))]
        return max(fit)[2] if fit and sum(c.isalpha() and c != lexicon.LOST for c in word) >= 2 else None
    fit = [(-s if lost else 0, m, o) for o, m in ordinary.items() if o != word and (s := lexicon.undone(word, o)) is not None and (lost or m >= (1 if digits else ratio) * n) and not (digits and len(word) == 2 and m < ratio * n)]
    return max(fit)[2] if fit else None


def misread(spark, ordinary, words):
    rows = [(w, n, n) for w, n in ordinary.items()] + [(w, 1, 1) for w in words if w not in ordinary]
    counts = spark.createDataFrame(rows, "word string, n bigint, small bigint")
    return {r.word: r.meant for r in lexicon.misread_words(counts).collect()}


def test_misread_words(spark):
    ordinary = {"every": 500, "which": 300, "group": 200, "lemma": 90, "centre": 50, "of": 900, "possesses": 500, "collineation": 400, "accessibilities": 300, "début": 80}
    want = {"evcry": "every", "wh1ch": "which", "gr�up": "group", "groiip": "group", "lernma": "lemma", "0f": "of", "p0ssesse5": "possesses", "p055e55e5": "possesses", "c0ll1ne4ti0n": "collineation", "acccssibilities": "accessibilities", "accessibilitics": "accessibilities", "acc�ssibilitics": "accessibilities", "dé8ut": "début", "gr��p": "group"}
    others = ["center", "v1", "l2", "�", "possess", "0000", "gr", "c1"]
    got = misread(spark, ordinary, [*want, *others])
    assert got == want
    assert {w: m for w in [*want, *others] if (m := brute_meant(w, 1, ordinary))} == want


def test_misread_words_against_brute_force(spark):
    rng = random.Random(12)
    ordinary = {"".join(rng.choice("aeilmncdhubrwo") for _ in range(rng.randint(3, 8))): rng.randint(5, 4000) for _ in range(150)}
    words = set()
    for o in rng.sample(sorted(ordinary), 120):
        w = o
        for _ in range(rng.randint(1, 3)):
            a, b = rng.choice([(x, y) for x, ys in lexicon.CONFUSED.items() if x != "|" for y in ys] + [("�", c) for c in "aeiou"])
            w = w.replace(b, a, 1)
        words.add(w)
    words = {w for w in words if w not in ordinary}
    got = misread(spark, ordinary, words)
    known = {w: n for w, n in ordinary.items() if n >= 5}
    assert {w: got.get(w) for w in words} == {w: brute_meant(w, 1, known) for w in words}


def test_misread_halves_of_a_split_word(spark):
    """A word split over a line end is looked at as a whole: its halves say nothing."""
    rows = [(i, "the regular graded kind") for i in range(40)] + [(90, "the reg¬\niilar kind"), (91, "the gra-\ncled kind"), (92, "the reg-\nular kind"), (93, "the ki�d")]
    units = spark.createDataFrame(rows, "unit_id bigint, content string")
    pages = spark.createDataFrame([], "scan_id bigint, page_height double, blocks array<struct<block_id:int,block_type:string,text:string,bbox:array<double>,font_size:double,is_bold:boolean>>")
    got = {(r.record_id, r.noise) for r in scans.scan_noise(units, pages).collect()}
    assert got == {(90, "misread"), (90, "hyphenation"), (91, "misread"), (91, "hyphenation"), (92, "hyphenation"), (93, "misread")}
    fixed = {r.record_id: r.text for r in scans.repaired(units, pages).collect()}
    assert fixed[90] == "the regular kind" and fixed[91] == "the graded kind"


def test_own_hyphens_are_kept(spark):
    """A compound that the corpus writes with its hyphen is no split word, a word it writes whole is."""
    plain = ["the torsion-free group of the following kind"] * 6
    rows = [(i, t) for i, t in enumerate([*plain, "a torsion-\nfree group", "the follow-\ning kind", "the unseen-\nish word"])]
    units = spark.createDataFrame(rows, "unit_id bigint, content string")
    pages = spark.createDataFrame([], "scan_id bigint, page_height double, blocks array<struct<block_id:int,block_type:string,text:string,bbox:array<double>,font_size:double,is_bold:boolean>>")
    got = {r.record_id for r in scans.scan_noise(units, pages).collect() if r.noise == "hyphenation"}
    assert got == {7, 8}
    fixed = {r.record_id: r.text for r in scans.repaired(units, pages).collect()}
    assert fixed[6] == "a torsion-free group" and fixed[7] == "the following kind"


def test_scan_noise_of_tables(spark):
    block = "array<struct<block_id:int,block_type:string,text:string,bbox:array<double>,font_size:double,is_bold:boolean>>"
    units = spark.createDataFrame([(1, "We g0 to the gr0up of which"), (2, None), (3, "")] + [(i, "the group of which the group is") for i in range(10, 60)], "unit_id bigint, content string")
    page = [(0, "text", "17", [50.0, 10.0, 60.0, 20.0], 8.0, False), (1, "heading", "1.2 First Results", [50.0, 60.0, 99.0, 70.0], 14.0, True), (2, "image", "[image]", None, 0.0, False)]
    pages = spark.createDataFrame([(7, 666.0, page), (8, None, None), (9, 666.0, [])], f"scan_id bigint, page_height double, blocks {block}")
    got = {tuple(r) for r in scans.scan_noise(units, pages).collect()}
    assert ("block", 7, 0, "page_number") in got and ("unit", 1, -1, "misread") in got and not any(r[2] == 1 for r in got)
    long = "A Course in the Theory of Very Long Running Heads that Go On and On Beyond Any Limit of Ninety Characters | 12"
    page = [(0, "text", long, [50.0, 10.0, 60.0, 20.0], 8.0, False), (1, "text", "Page 12.", [50.0, 300.0, 60.0, 310.0], 10.0, False)]
    pages = spark.createDataFrame([(7, 666.0, page)], f"scan_id bigint, page_height double, blocks {block}")
    assert {tuple(r) for r in scans.scan_noise(units.limit(0), pages).collect()} == {("block", 7, 0, "header")}
    assert scans.scan_noise(units.limit(0), pages.limit(0)).count() == 0 and scans.repaired(units.limit(0), pages.limit(0)).count() == 0


# --- survivors ------------------------------------------------------------------------------------

SV = "unit_id bigint, _doc_id string, unit_index int, label string, content string, number_components array<int>, method string, extracted_at timestamp, group_id string"


def test_surviving_values(spark):
    t = dt.datetime(2024, 1, 1)
    whole = "Let A be a space with some property. Then every map of A is open."
    rows = [
        (1, "d", 0, "Theorem 1.", whole, [1, 2], "gold", t, "x"),
        (2, "d", 0, "Theorem 1.2", whole[:40], [1, 2], "rule", t, "x"),
        (3, "d", 0, "Thm. 1.2", whole, [1, 2], "llm", t, "x"),
        (4, "d", 1, "Lemma 1.3 (Zorn)", "", [1, 3], "rule", t, "x"),
        (5, "d", 1, "Lemma 1.3", whole, [1, 3], "gold", t, "x"),
        (6, "d", 2, "Lemma 1.4", whole, [1, 4], "gold", t, "x"),
        (7, None, 3, "Lemma 1.4", None, None, "gold", t, "x"),
        (8, "d", 4, None, None, None, None, None, "x"),
        (9, "d", 4, None, None, None, "rule", None, "x"),
        (9, "d", 4, None, None, None, "rule", None, "x"),
    ]
    methods = spark.createDataFrame([("gold", 1), ("llm", 4), ("rule", 5)], "method string, trust_rank int")
    got = {(r.unit_id, r.group_id, r.label_from, r.content_from) for r in survivors.surviving(spark.createDataFrame(rows, SV), methods).collect()}
    assert got == {(1, 1, 2, 1), (2, 1, 2, 1), (3, 1, 2, 1), (4, 4, 4, 5), (5, 4, 4, 5), (8, 8, 9, 9), (9, 8, 9, 9)}
    golden = survivors.golden_records(spark.createDataFrame(rows, SV), methods)
    assert golden.count() == 5
    assert survivors.surviving(spark.createDataFrame([], SV), methods).count() == 0


def test_the_iteration_decides(spark):
    """Two sources agree on a noisy wording; only what the other groups teach about noise makes the clean one survive."""
    rows, clean = [], "Let A be a space with some property. Then every map of A is open."
    noisy = clean.replace("space", "sp\ufffdce")
    n = 0
    for g in range(60):
        for m, text in (("gold", clean), ("rule", noisy)) if g else (("gold", clean), ("rule", noisy), ("llm", noisy)):
            n += 1
            rows.append((n, "d", g, "Lemma 1.4", f"{text}", [1, 4], m, None, "x"))
    df, methods = spark.createDataFrame(rows, SV), spark.createDataFrame([("gold", 3), ("llm", 1), ("rule", 2)], "method string, trust_rank int")
    settled = {r.content_from for r in survivors.surviving(df, methods).collect() if r.group_id == 1}
    equal = {r.content_from for r in survivors.surviving(df, methods, rounds=0).collect() if r.group_id == 1}
    assert settled == {1} and equal != {1}
    told = survivors.reliabilities(df, methods).where("field = 'content'").collect()
    assert all(r.converged for r in told) and {r.condition: r.reliability > 0.5 for r in told} == {"whole clean": True, "whole noisy": False}


# --- packing --------------------------------------------------------------------------------------


def test_every_text_is_packed_once(spark):
    rng = random.Random(2)
    words = "set map ring field graph prime".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(300)] + [(900, "word " * 700), (901, ""), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 128), ("l", 512), ("none", 0)], "profile string, capacity_tokens int")
    out = packing.packed_containers(docs, sizes, shard_items=100).toPandas()
    for profile, capacity in (("s", 128), ("l", 512)):
        own = out[out.profile == profile]
        assert own.groupby("container_id").tokens.sum().max() <= capacity
        assert set(own.doc_id) == {r[0] for r in rows} and not own.duplicated(["doc_id", "piece"]).any()
        big = own[own.doc_id == 900].sort_values("piece")
        assert list(big.start_token) == [i * capacity for i in range(len(big))]
        assert (own[own.doc_id < 900].piece == 0).all()
        assert own.tokens.sum() / (own.container_id.nunique() * capacity) > 0.93
    assert packing.packed_containers(spark.createDataFrame([], "doc_id bigint, text string"), sizes).count() == 0


def test_null_and_repeated_ids_are_packed(spark):
    big = 2**60 + 1
    rows = [(None, "ring of sets"), (None, None), (None, "word " * 300), (5, "a map"), (5, "a map"), (5, "word " * 300), (5, "word " * 300), (big, "a graph"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 128)], "profile string, capacity_tokens int")
    out = packing.packed_containers(docs, sizes).collect()
    size = packing.packed_items(spark.createDataFrame([(1, "word " * 300)], "doc_id bigint, text string"), []).first().n_tokens
    per = -(-size // 128)
    assert len(out) == 6 + 3 * per
    assert sum(r.doc_id is None for r in out) == 2 + per and sum(r.doc_id == 5 for r in out) == 2 + 2 * per and sum(r.doc_id == big for r in out) == 1
    room = {}
    for r in out:
        room[r.container_id] = room.get(r.container_id, 0) + r.tokens
    assert max(room.values()) <= 128 and len({(r.container_id, r.slot) for r in out}) == len(out)


def test_shards_keep_neighbours_together(spark):
    """Texts of three vocabularies: the tree parts them, so that BM25 neighbours share a shard and a container."""
    rng = random.Random(9)
    kinds = [[f"{k}{i}" for i in range(30)] for k in ("alpha", "beta", "gamma")]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(10, 40)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 512)], "profile string, capacity_tokens int")
    assert packing.neighbour_recall(docs, sizes, queries=60, shard_items=200) >= 0.9
    boxes = {}
    for r in packing.packed_containers(docs, sizes, shard_items=200).collect():
        boxes.setdefault(r.container_id, []).append(r.doc_id % 3)
    pure = sum(len(set(b)) == 1 for b in boxes.values()) / len(boxes)
    assert pure > 0.8


def test_rests_have_their_own_terms(spark):
    docs = spark.createDataFrame([(1, "alpha " * 300 + "omega " * 20)], "doc_id bigint, text string")
    rest = [r for r in packing.packed_items(docs, [("s", 100)]).collect() if r.part == 0]
    whole = [r for r in packing.packed_items(docs, [("s", 100)]).collect() if r.part == -1]
    assert len(rest) == 1 and len(whole[0].terms) == 2 and sum(rest[0].counts) < sum(whole[0].counts) / 3


# --- mixing ---------------------------------------------------------------------------------------


def test_shares_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, f"{s} " + " ".join(rng.choice("abc def ghi jkl".split()) for _ in range(rng.randint(5, 40))), s) for i, s in enumerate(["big"] * 400 + ["mid"] * 150 + ["small"] * 20 + ["other"] * 50)] + [(9000, None, "big"), (9001, "", "mid"), (9002, "big abc", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), (None, 0.1, 1)], "source_name string, target_share double, max_repeats int")
    mixed = mixing.mixture(docs, targets)
    rows = mixed.collect()
    caps = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r.repeats <= caps.get(r.source, 3) for r in rows) and all(r.source != "other" for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    shares = {r.source: r.reached_share for r in mixing.reached_shares(mixed, targets).collect()}
    assert shares == pytest.approx({"big": 0.5, "mid": 0.3, "small": 0.2}, abs=0.03)
    assert mixing.mixture(spark.createDataFrame([], "doc_id bigint, text string, source string"), targets).count() == 0


def test_text_posteriors_and_gradient_decide(spark):
    """Documents without a source count for the source their text is like; rates follow the texts inside a source."""
    rng = random.Random(5)
    words = {"a": "ring ideal module field".split(), "b": "graph edge clique tree".split()}
    text = lambda s: " ".join(rng.choice(words[s]) for _ in range(30))
    rows = [(i, text("a"), "a") for i in range(200)] + [(i, text("b"), "a") for i in range(200, 300)] + [(i, text("b"), "b") for i in range(300, 400)] + [(900 + i, text("a"), None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source_name string, target_share double, max_repeats int")
    drawn = {r.doc_id: (r.source, r.repeats) for r in mixing.mixture(docs, targets).collect()}
    assert {drawn[i][0] for i in range(900, 940) if i in drawn} == {"a"}
    still = {r.doc_id for r in mixing.mixture(docs, targets, rounds=0).collect()}
    # Half of the texts like b's are a's, so the draw has too much that reads like a: a's own kind gives way.
    assert sum(i in drawn for i in range(200)) < sum(i in still for i in range(200))
    report = mixing.fit_report(docs, targets).first()
    assert report.converged and report.accuracy > 0.6 and report.source_gap < 0.01


# --- subjects -------------------------------------------------------------------------------------


def test_held_out_subjects(spark):
    rng = random.Random(4)
    terms = {"a": ["ring", "ideal", "module", "coset"], "b": ["graph", "edge", "clique", "tree"], "c": ["prime", "sieve", "residue", "divisor"]}

    def sentence(s):
        x, y = rng.sample(terms[s], 2)
        return rng.choice([f"Every {x} has a {y}.", f"The {x} meets some {y} here.", f"Each {x} and {y} agree."])

    rows, truth = [], {}
    for i in range(240):
        own = rng.sample("abc", 2) if i % 6 == 0 else [rng.choice("abc")]
        truth[i] = set(own)
        body = [sentence(s) for s in own for _ in range(4)]
        rows.append((i, " ".join(body + ["Nothing else is needed."])))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    areas = spark.createDataFrame([(s,) for s in "abc"], "subject string")
    labels = spark.createDataFrame([(i, s, "x") for i in range(0, 240, 4) for s in truth[i]] + [(1, "zzz", "x")], "doc_id bigint, subject string, annotator string")
    got = {}
    for r in subjects.document_subjects(docs, areas, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i % 4]
    assert sum(got.get(i) == truth[i] for i in held) / len(held) > 0.9
    assert 900 not in got and 901 not in got
    assert subjects.document_subjects(docs.limit(0), areas, labels.limit(0)).count() == 0
    report = subjects.propagation_report(docs, areas, labels).first()
    assert report.converged and report.rounds <= 10


def test_trusted_seeds_are_clamped(spark):
    """A label that the document's sentences bear out stays, whatever the rest says; one they speak against is not trusted."""
    a, b = "Every ring has an ideal. The ring meets some ideal here.", "Every graph has an edge. The graph meets some edge here."
    rows = [(i, (a, b)[i % 2]) for i in range(60)] + [(100, f"{a} {b} {b} {b} {b} {b}"), (101, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    areas = spark.createDataFrame([("a",), ("b",)], "subject string")
    labels = spark.createDataFrame([(i, "ab"[i % 2], "x") for i in range(30)] + [(100, "a", "x"), (101, "b", "x")], "doc_id bigint, subject string, annotator string")
    got = {}
    for r in subjects.document_subjects(docs, areas, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert got[100] == {"a", "b"} and got[101] == {"a"}


def test_large_weights_are_joined(spark, monkeypatch):
    """Beyond the size of a broadcast the terms are joined; the result is the same."""
    rows = [(i, f"Every {x} has a {y}. The {x} meets some {y} here. {z}") for i in range(60) for x, y, z in [(("ring", "ideal", "A coset."), ("graph", "edge", "A tree."))[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    areas = spark.createDataFrame([("a",), ("b",)], "subject string")
    labels = spark.createDataFrame([(i, "ab"[i % 2], "x") for i in range(20)], "doc_id bigint, subject string, annotator string")
    run = lambda: {tuple(r) for r in subjects.document_subjects(docs, areas, labels).collect()}
    small = run()
    monkeypatch.setattr(subjects, "small_enough", lambda df: False)
    assert run() == small and len(small) == 60


def test_silent_seeds_keep_their_labels(spark):
    rows = [(i, f"Every {x} has a {y}. The {x} meets some {y} here.") for i in range(40) for x, y in [(("ring", "ideal"), ("graph", "edge"))[i % 2]]]
    docs = spark.createDataFrame(rows + [(100, "Zeta omega."), (101, " "), (102, None), (103, "Kappa rho.")], "doc_id bigint, text string")
    areas = spark.createDataFrame([("a",), ("b",)], "subject string")
    given = [(i, "ab"[i % 2], "x") for i in range(20)] + [(100, "b", "x"), (100, "b", "y"), (100, "zzz", "x"), (101, "a", "x"), (102, "a", "x"), (999, "a", "x"), (1, "a", "y")]
    labels = spark.createDataFrame(given, "doc_id bigint, subject string, annotator string")
    got = {(r.doc_id, r.subject, r.share) for r in subjects.document_subjects(docs, areas, labels).collect()}
    assert {x for x in got if x[0] >= 100} == {(100, "b", 1.0)}
    assert {x[:2] for x in got if x[0] < 40} == {(i, "ab"[i % 2]) for i in range(40)}


def test_very_long_texts(spark):
    """Texts of some 200 000 characters, of one line and of many, pass every operator whole."""
    plain = "the group of which every element is so " * 5000
    rows = [(1, "d", 0, "Lemma 1.1", f"It is: {plain}= 3", [1, 1], "gold", None, "x"), (2, "d", 0, "Lemma 1.1", plain.replace(" of ", " of\n") + ".", [1, 1], "llm", None, "x"), (3, "e", 1, "Lemma 1.1", "([{" * 60000, None, None, None, "x")]
    units = spark.createDataFrame(rows, SV)
    docs = units.selectExpr("unit_id AS doc_id", "content AS text", "method AS source")
    hosts = units.selectExpr("_doc_id AS host", "unit_id AS id", "content AS text")
    pages = spark.createDataFrame([], "scan_id bigint, page_height double, blocks array<struct<block_id:int,block_type:string,text:string,bbox:array<double>,font_size:double,is_bold:boolean>>")
    assert lookalikes.canonical_text(units, "unit_id", "content").count() == 3
    assert markup.clean_texts(hosts).count() == 3 and markup.markup_families(hosts).count() == 0
    assert {(r.unit_id, r.field_name) for r in truncation.cut_values(units).collect()} == {(1, "content"), (3, "content")}
    assert scans.repaired(units, pages).count() == 3 and scans.scan_noise(units, pages).count() == 0
    methods = spark.createDataFrame([("gold", 1)], "method string, trust_rank int")
    assert {r.content_from for r in survivors.surviving(units, methods).collect()} == {2}
    packed = packing.packed_containers(docs, spark.createDataFrame([("s", 1000)], "profile string, capacity_tokens int"))
    assert packed.groupBy("container_id").sum("tokens").agg({"sum(tokens)": "max"}).first()[0] == 1000
    areas, labels = spark.createDataFrame([("a",)], "subject string"), spark.createDataFrame([(1, "a", "x")], "doc_id bigint, subject string, annotator string")
    assert {r.doc_id for r in subjects.document_subjects(docs, areas, labels).collect()} >= {1}


def test_extra_columns_with_clashing_names(spark):
    """Columns named like those an operator makes inside are no matter."""
    rows = [(1, "d", 0, "Lemma 1.1", "It holds for all.", [1, 1], "gold", None, "x"), (2, "d", 0, "Lem. 1.1", "It holds for all.", [1, 1], "llm", None, "x")]
    units = spark.createDataFrame(rows, SV)
    for name in ("id", "kind", "text", "value", "rank", "look", "form", "chars", "ending", "source", "weight", "h", "word", "n", "place"):
        units = units.withColumn(name, units.group_id)
    methods = spark.createDataFrame([("gold", 1, "x")], "method string, trust_rank int, weight string")
    assert survivors.surviving(units, methods).count() == 2
    assert truncation.cut_values(units).count() == 0 and lookalikes.same_look_pairs(units).count() == 0
    docs = units.selectExpr("unit_id AS doc_id", "content AS text", "'a' AS source", "id", "word AS terms", "kind AS part", "n AS post", "h", "rank AS domain", "form AS row_id", "look AS given")
    sizes = spark.createDataFrame([("s", 50, "x")], "profile string, capacity_tokens int, kind string")
    assert packing.packed_containers(docs, sizes).count() == 2
    targets = spark.createDataFrame([("a", 1.0, 1, "x")], "source_name string, target_share double, max_repeats int, cap string")
    assert mixing.mixture(docs, targets).count() == 2
    areas = spark.createDataFrame([("a", "x")], "subject string, doc_id string")
    labels = spark.createDataFrame([(1, "a", "x")], "doc_id bigint, subject string, given string")
    assert {r.doc_id for r in subjects.document_subjects(docs, areas, labels).collect()} >= {1}


def test_registered_queries():
    from folioscope.llm import queries

    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6, 9)} <= set(queries.QUERIES)
