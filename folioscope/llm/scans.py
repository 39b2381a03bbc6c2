"""Noise in text from scanned pages.

The lines of a text are labelled body, break (a word goes on in the next body line), header or page
number by a hidden Markov model over shape, context and layout features. Its emissions and
transitions are trained by hard expectation-maximisation on all texts of the corpus, from a few
labelled examples. The most probable label sequence of the whole text decides; nothing filters it
afterwards. Misread words come from the corpus lexicon. The labels drive the
reassembly into paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import lexicon
from folioscope.session import materialize

STATES = ("body", "break", "header", "page_number")
BODY, BREAK, HEADER, PAGE_NUMBER = range(4)
#: Labelled texts the training starts from: (state, line) in order.
EXAMPLES = (
    (("body", "the following holds for every space that"), ("header", "A Course in Modern Algebra"), ("body", "is compact and has no element of this kind.")),
    (("break", "Suppose that X is a compact space which is de-"), ("body", "termined by its closed subsets of A."), ("page_number", "12"), ("body", "Here we need")),
    (("break", "no element of this homo‐"), ("page_number", "– 3 –"), ("body", "morphism is closed under sums"), ("header", "Notes on Analysis | 12"), ("body", "for which n > 3. Then")),
    (("body", "x = y holds for all of them with"), ("header", "CHAPTER 3. FIRST RESULTS"), ("body", "0 < x < 5 and"), ("page_number", "[7]"), ("body", "boundary.")),
    (("break", "Lemma 1.2 Let A be con­"), ("header", "1.4 Basic Notions  6"), ("body", "tinuous, and Chap. 2 holds"), ("page_number", "Page 5"), ("body", "of A. Then")),
    (("header", "24  ELEMENTS OF LOGIC"), ("body", "in every case"), ("header", "Chap. 2   Limits and Bounds   17"), ("body", "which we use."), ("page_number", "xiv")),
    (("break", "for every inte¬"), ("body", "gral of this kind we have x² + y² ="), ("body", "12")),
    (("body", "The map is onto as soon as f(x) ≤"), ("body", "46")),
    (("body", "of A for which d(v, V) <"), ("body", "7")),
    (("body", "This holds whenever n ="), ("body", "103")),
    (("body", "## A Title of Two Words"), ("body", "Theorem 1.2 Main Result"), ("body", "- Item One | Two"), ("body", "y ∈ Y, and |Y| =")),
    (("body", "[[Category:Entries Two]]"), ("body", "{| class"), ("body", "|-"), ("body", "| 1 || 2"), ("body", "|}"), ("body", "|---|---|"), ("body", "--------------"), ("body", "holds.")),
    (("body", "which is needed when"), ("header", "Topics in Modern Number theory"), ("body", "every space is compact"), ("page_number", "viii"), ("body", "and so on")),
    (("header", "Notes on Analysis | 12"), ("header", "1.4 Basic Notions  6"), ("page_number", "· 18 ·"), ("page_number", "- 4 -"), ("page_number", "p. 9")),
)
#: Likelihood of a place on the page given each state: unknown, small type at the edge, reading type, large type.
PLACES = ((1.0, 1.0, 1.0, 1.0), (0.01, 0.01, 0.97, 0.97), (0.97, 0.97, 0.03, 0.03), (0.97, 0.97, 0.001, 0.001))
UNKNOWN, EDGE, READING, LARGE = range(4)
HEADER_FONT, LARGE_FONT = 9.5, 13.0
#: How many texts a larger corpus weighs as against the examples, whatever its size.
MASS = 20_000
_HYPHENS = "-‐­¬"

# Signs of furniture in a line without outer blanks; the first that holds is the line's sign.
_PAGE = r"(?i)^(?:[\[(–—·•*-]\s*)?(?:(?:page|p\.|seite|s\.)\s*)?(?:\d{1,4}|[ivxlc]{1,7})(?:\s*[\])–—·•*-])?$"
_SIGNS = (
    _PAGE,
    r"^\d+(?:\.\d+)+\s+\p{Lu}.*\s{2,}\d+$",  # section and page
    r"^\d+(?:\s{2,}|\s*\|\s*)\pL",  # number in front
    r"\pL(?:\s{2,}|\s*\|\s*)\d+$",  # number behind
    r"(?i)^(?:chap(?:ter|\.)|kap(?:itel|\.))\s*\d",
    r"^(?:[^\pL]*\p{Lu}){8}[^\p{Ll}]*$",  # capitals only
)
#: Three more signs (a number where an operand is due, title case, title case but for one word) and none.
SIGNS = len(_SIGNS) + 4
# Other shape features.
_BROKEN, _LOWER = r"\pL[-‐\x{ad}¬]$", r"^\p{Ll}"
_MARKUP = r"^(?:#|==|\{|\[\[|\\|<|`)"
_SHAPES = (
    r"[.!?;,:∎□]$",
    r"[=<>≤≥∈⊂⊃∩→‖ε²{}\\$&*`]",
    r"(?i)^(?:definition|theorem|lemma|proposition|corollary|example|remark|exercise|proof|def|thm|lem|prop|cor|exmp|rem|exerc)\b",
    r"^[>|!+*-]",  # begins like a list or table
    _MARKUP,
    r"^[^\pL\pN]*$",  # a rule
    r"^.{60}",
)
_RUNS_ON = r"^(?:(?i:chapter \d+\.|chap\w*\.))?.*(?:[.;,]\s|\pL–\pL)"
_LONG_WORD, _LONG_CAPITAL = r"\pL{4,}", r"(?:^|[^\pL])\p{Lu}\pL{3,}"
_OPERAND_NEXT = r"[=<>≤≥+*·−∈⊂∩∖→,(|]$"


def _flags(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _counts(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


class Looks:
    """The features of the lines of many texts, one after the other, as a matrix of flags; all that training needs."""

    features: np.ndarray
    blank: np.ndarray
    broken: np.ndarray
    mere: np.ndarray
    counts: np.ndarray
    starts: np.ndarray

    @staticmethod
    def read(packed: pa.Array) -> tuple[Looks, np.ndarray]:
        """The features and places that :meth:`packed` made of texts."""
        numbers = np.frombuffer(b"".join(packed.to_pylist()), np.int32)
        looks = Looks()
        looks.counts = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64) // 4 - 1
        looks.starts = np.concatenate([[0], np.cumsum(looks.counts)[:-1]]).astype(np.int64)
        at = looks.starts + np.arange(len(packed))
        codes = np.delete(numbers, at)
        looks.features = (codes[:, None] >> np.arange(FEATURES) & 1).astype(np.float64)
        looks.blank = (codes >> FEATURES & 1).astype(bool)
        looks.broken = looks.features[:, _BROKEN_AT] > 0
        looks.mere = looks.features[:, :MERE_SIGNS].any(axis=1)
        return looks, numbers[at]

    def packed(self, place: np.ndarray) -> pa.Array:
        """A binary per text: its place as far as that is evidence, then the features of each line as bits of a number."""
        codes = (self.features @ (1 << np.arange(FEATURES)).astype(np.float64)).astype(np.int32) | self.blank.astype(np.int32) << FEATURES
        numbers = np.insert(codes, self.starts, known_place(self, place)).astype(np.int32)
        ends = 4 * np.concatenate([[0], np.cumsum(self.counts + 1)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self.counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(numbers.tobytes())])


class Lines(Looks):
    """The lines of many texts, one after the other, and their features."""

    def __init__(self, texts: pa.Array):
        split = pc.split_pattern(texts.cast(pa.string()), "\n")
        self.lines = split.flatten()
        self.counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)
        self.stripped = pc.utf8_trim_whitespace(self.lines)
        signs = [_flags(self.stripped, p) for p in _SIGNS]
        self.blank = pc.equal(self.stripped, "").to_numpy(zero_copy_only=False)
        page, broken = signs[0], _flags(self.stripped, _BROKEN)
        # A number in small Roman digits does not begin a sentence's second half.
        lower = _flags(self.stripped, _LOWER) & ~page
        n = len(self.lines)
        first = np.repeat(self.starts, self.counts)
        # The line before, furniture of mere numbers and blank lines passed over.
        seen = np.maximum.accumulate(np.where(~self.blank & ~page, np.arange(n), -1)) if n else np.zeros(0, np.int64)
        before = np.concatenate([[-1], seen[:-1]]) if n else seen
        before = np.where(before >= first, before, -1)
        goes_on = np.where(before >= 0, broken[before], False)
        operand = np.where(before >= 0, _flags(self.stripped, _OPERAND_NEXT)[before], False)
        last = np.zeros(n, bool)
        last[self.starts + self.counts - 1] = True
        words, capitals = _counts(self.stripped, _LONG_WORD), _counts(self.stripped, _LONG_CAPITAL)
        runs_on = _flags(self.stripped, _RUNS_ON)
        titled = ~runs_on & (words >= 2) & ~_flags(self.stripped, _MARKUP)
        # A mere number that ends the text where an operand is due is a sign of its own.
        signs = [page & operand & last, *signs]
        signs += [titled & (capitals == words), titled & (words >= 4) & (capitals == words - 1)]
        sign = np.select(signs, range(len(signs)), len(signs))
        self.features = np.column_stack([
            *(sign == k for k in range(SIGNS)),
            *(_flags(self.stripped, p) for p in _SHAPES),
            ~page & ~_flags(self.stripped, r"\pL{2}"),
            broken,
            lower,
            runs_on,
            words - capitals >= 2,
            goes_on & lower,
            goes_on & ~lower & ~page,
        ]).astype(np.float64)
        self.broken, self.mere = broken, page


FEATURES = SIGNS + len(_SHAPES) + 7
#: The first signs are those of mere numbers; the column of ``broken``.
MERE_SIGNS, _BROKEN_AT = 2, SIGNS + len(_SHAPES) + 1


def known_place(lines: Looks, place: np.ndarray) -> np.ndarray:
    """The places that are evidence: those of lone lines and of blocks at the edge."""
    return np.where((lines.counts == 1) | (place == EDGE), place, UNKNOWN)


class LineModel:
    """Log odds of the features per state, and log chances of the moves between states."""

    def __init__(self, on: np.ndarray, lines: np.ndarray, moves: np.ndarray, first: np.ndarray):
        """``on``: (states, features) counts; ``lines``: lines per state; ``moves``: (from, to) counts; ``first``: first lines per state."""
        one = np.clip((on[:, :SIGNS] + 0.1) / (lines[:, None] + 0.1 * SIGNS), 1e-4, 1.0)
        share = np.clip((on[:, SIGNS:] + 0.2) / (lines[:, None] + 0.4), 1e-4, 1 - 1e-4)
        self.base = np.log(1 - share).sum(axis=1)
        self.gain = np.column_stack([np.log(one), np.log(share) - np.log(1 - share)]).T
        self.move = np.log((moves + 0.5) / (moves + 0.5).sum(axis=1, keepdims=True))
        self.first = np.log((first + 0.5) / (first + 0.5).sum())

    def label(self, lines: Looks, place: np.ndarray | None = None) -> np.ndarray:
        """The likeliest states of all lines of each text together (Viterbi). Blank lines are body.

        ``place`` (a number of PLACES per text) is evidence for a lone line, and for every line of a block at the edge.
        """
        sign = lines.features[:, :SIGNS] @ self.gain[:SIGNS]
        # A mere number can't show any other feature: their absence says nothing.
        emission = sign + np.where(lines.mere[:, None], 0.0, self.base + lines.features[:, SIGNS:] @ self.gain[SIGNS:])
        if place is not None:
            emission = emission + np.log(np.array(PLACES))[np.repeat(known_place(lines, place), lines.counts)]
        emission[lines.blank] = (0.0, -99.0, -99.0, -99.0)
        return _viterbi(emission, lines.starts, lines.counts, self.move, self.first)


def _viterbi(emission: np.ndarray, starts: np.ndarray, counts: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All texts at once, line by line; the longest texts come first, so those that go on are a prefix."""
    labels = np.zeros(len(emission), np.int8)
    if not len(starts):
        return labels
    order = np.argsort(-counts, kind="stable")
    begin, size = starts[order], counts[order]
    best = first + emission[begin]
    came = np.zeros(emission.shape, np.int8)
    going = [len(size)]
    for t in range(1, int(size[0])):
        m = int(np.searchsorted(-size, -t, side="left"))
        at = begin[:m] + t
        reach = best[:m, :, None] + move
        came[at] = reach.argmax(axis=1)
        best[:m] = reach.max(axis=1) + emission[at]
        going.append(m)
    labels[begin + size - 1] = best.argmax(axis=1)
    for t in range(int(size[0]) - 1, 0, -1):
        at = begin[: going[t]] + t
        labels[at - 1] = came[at, labels[at]]
    return labels


def _tally(lines: Looks, labels: np.ndarray, place: np.ndarray | None = None, times: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Counts of features, lines, moves and first lines per state; blank lines have no features to learn from.

    Each text counts as often as ``times`` says, or once.

    With ``place``, the layout teaches the look: lines of blocks at the edge are furniture, all others
    body or break, whatever their label says (mere numbers labelled as page numbers are left out);
    the labels teach the moves and which of the two it is.
    """
    seen, looks = ~lines.blank, labels
    if place is not None:
        edge = np.repeat(place == EDGE, lines.counts)
        seen &= np.where(edge, labels >= HEADER, ~lines.mere | (labels != PAGE_NUMBER))
        looks = np.where(edge | (labels < HEADER), labels, np.where(lines.broken, BREAK, BODY))
    times = np.ones(len(lines.counts)) if times is None else times.astype(float)
    each = np.repeat(times, lines.counts)
    on = np.array([each[mine] @ lines.features[mine] for mine in (seen & (looks == s) for s in range(4))])
    many = lines.counts > 1
    inner = np.ones(len(labels), bool)
    inner[lines.starts] = False
    at = np.flatnonzero(inner)
    moves = np.zeros((4, 4))
    np.add.at(moves, (labels[at - 1], labels[at]), each[at])
    first = np.bincount(labels[lines.starts[many]], times[many], minlength=4)
    return on, np.bincount(looks[seen], each[seen], minlength=4), moves, first


def _examples() -> tuple[np.ndarray, ...]:
    lines = Lines(pa.array(["\n".join(line for _, line in text) for text in EXAMPLES]))
    return _tally(lines, np.array([STATES.index(state) for text in EXAMPLES for state, _ in text]))


def _trained(tally: Callable[[LineModel], tuple[np.ndarray, ...]] | None, texts: int, rounds: int, weight: float) -> LineModel:
    """Hard expectation-maximisation: the texts are labelled by the model so far, the counts of these labels
    (``tally``) make the next one, until no count changes or ``rounds`` are over.

    The counts of more than MASS texts are scaled to those of MASS texts: what the examples say of the states
    must not fade as the corpus grows, or headers and page numbers change places.
    """
    given = [weight * x for x in _examples()]
    model, old = LineModel(*given), None
    for _ in range(rounds if tally is not None else 0):
        new = tally(model)
        if old is not None and all(np.array_equal(a, b) for a, b in zip(new, old)):
            break
        old = new
        model = LineModel(*(a + b * min(1.0, MASS / max(texts, 1)) for a, b in zip(given, new)))
    return model


def train(texts: pa.Array | None = None, place: np.ndarray | None = None, rounds: int = 6, weight: float = 3.0) -> LineModel:
    """A model from the examples (each counts ``weight`` times) and, if given, unlabelled texts, by one process."""
    if texts is None or not len(texts):
        return _trained(None, 0, rounds, weight)
    lines = Lines(texts)
    return _trained(lambda model: _tally(lines, model.label(lines, place), place), len(texts), rounds, weight)


def scan_texts(units: DataFrame, pages: DataFrame) -> DataFrame:
    """(kind, id, block_id, text, place) of unit contents and page blocks with a text; ``place`` as in PLACES.

    NULL, blank and image texts are left out.
    """
    of_units = units.select(F.lit("unit").alias("kind"), F.col("unit_id").cast("bigint").alias("id"), F.lit(-1).alias("block_id"), F.col("content").alias("text"), F.lit(UNKNOWN).alias("place"))
    b = F.col("b")
    top, bottom = F.try_element_at(b["bbox"], F.lit(2)), F.try_element_at(b["bbox"], F.lit(4))
    height = F.coalesce("page_height", F.lit(666.0))
    edge = (b["font_size"] < HEADER_FONT) & (b["font_size"] > 0) & ((top < 0.08 * height) | (bottom > 0.9 * height))
    place = F.when(edge, EDGE).when((b["block_type"] == "heading") | (b["font_size"] > LARGE_FONT), LARGE).otherwise(READING)
    each = pages.select(F.col("scan_id").cast("bigint").alias("id"), "page_height", F.explode("blocks").alias("b"))
    of_blocks = each.where(F.coalesce(b["block_type"] != "image", F.lit(True))).select(F.lit("block").alias("kind"), "id", b["block_id"].cast("int").alias("block_id"), b["text"].alias("text"), place.alias("place"))
    return of_units.unionByName(of_blocks).where(F.col("text").rlike(r"\S"))


def learn_lines(texts: DataFrame, rounds: int = 6, weight: float = 3.0) -> LineModel:
    """The line model of a corpus, the same as :func:`train` makes of all its texts in one process.

    Texts whose lines look alike one by one are labelled alike, so they are kept once, with their number.
    Each round labels all of them; the counts are summed on the executors, and what comes to the driver is
    a few hundred numbers.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = pc.value_counts(Lines(batch.column(0)).packed(batch.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.binary()), counted.field(1)], names=["look", "n"])

    looks = materialize(texts.select("text", "place").mapInArrow(look, "look binary, n bigint").groupBy("look").agg(F.sum("n").alias("n")))
    shapes = [x.shape for x in _examples()]
    ends = np.cumsum([np.prod(x) for x in shapes])

    def tally(model: LineModel) -> tuple[np.ndarray, ...]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(ends[-1])
            for batch in batches:
                if len(batch):
                    lines, place = Looks.read(batch.column(0))
                    counts = _tally(lines, model.label(lines, place), place, batch.column(1).to_numpy())
                    total += np.concatenate([x.ravel() for x in counts])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "x"])

        total = np.zeros(ends[-1])
        # Whole numbers: their sum is the same in any order.
        for r in looks.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            total[r["i"]] = r["x"]
        return tuple(part.reshape(shape) for part, shape in zip(np.split(total, ends[:-1]), shapes))

    return _trained(tally, looks.agg(F.sum("n")).first()[0] or 0, rounds, weight)


_LEFT, _RIGHT = re.compile(rf"([^\W\d_]+)[{_HYPHENS}]\s*$"), re.compile(r"\s*([^\W\d_]+)")


def _splits(lines: Lines, labels: np.ndarray) -> Iterator[tuple[int, str | None]]:
    """(text, pair) of each word split at a line labelled break: furniture and blank lines between are passed over.

    ``pair`` is ``left-right`` in small letters if the hyphen may be the word's own, None if it is a mark of splitting only.
    """
    text_of = np.repeat(np.arange(len(lines.counts)), lines.counts)
    end = lines.starts + lines.counts
    for i in np.flatnonzero((labels == BREAK) & lines.broken):
        left = _LEFT.search(lines.stripped[i].as_py())
        j = i + 1
        while j < end[text_of[i]] and (labels[j] >= HEADER or lines.blank[j]):
            j += 1
        right = _RIGHT.match(lines.stripped[j].as_py()) if j < end[text_of[i]] else None
        if left and right and right.group(1)[0].islower():
            own = left.group(0).rstrip()[-1] == "-"
            yield int(text_of[i]), f"{left.group(1)}-{right.group(1)}".lower() if own else None


def line_noise(texts: DataFrame, model: LineModel) -> DataFrame:
    """(kind, id, block_id, noise, pair): header, page_number and hyphenation lines of the texts.

    Every text is labelled. A row with a ``pair`` is a hyphenation only if the pair is one word (see
    :meth:`lexicon.Words.joined`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines(batch.column(3))
            labels = model.label(lines, batch.column(4).to_numpy())
            text_of = np.repeat(np.arange(len(lines.counts)), lines.counts)
            found = [(int(i), STATES[s], None) for s in (HEADER, PAGE_NUMBER) for i in np.unique(text_of[labels == s])]
            found += [(i, "hyphenation", pair) for i, pair in set(_splits(lines, labels))]
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:3]), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())], names=["kind", "id", "block_id", "noise", "pair"])

    return texts.select("kind", "id", "block_id", "text", "place").mapInArrow(run, "kind string, id bigint, block_id int, noise string, pair string")


def noise_signs(texts: DataFrame, words: lexicon.Words, model: LineModel) -> DataFrame:
    """(kind, id, block_id, noise): a row per sign of noise, repeats of a kind in one text included."""
    keys = ["kind", "id", "block_id"]
    lines = materialize(line_noise(texts, model))
    asked = lines.where("pair IS NOT NULL")
    split = asked.join(words.joined(asked), "pair")
    misread = lexicon.with_misread(texts, words.bad, keys).select(*keys, F.lit("misread").alias("noise"))
    return lines.where("pair IS NULL").select(*keys, "noise").unionByName(split.select(*keys, "noise")).unionByName(misread)


def scan_noise(units: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_kind, record_id, block_id, noise): every kind of scan noise each text holds, once.

    NULL, blank and image texts have none; empty tables give an empty result.
    """
    texts = scan_texts(units, pages)
    signs = noise_signs(texts, lexicon.Words(texts), learn_lines(texts))
    return signs.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "block_id", "noise").distinct()


_OWN_LINE = re.compile(r"^\s*(?:#{1,6} |[-*+] |\d+[.)] |[>|!{]|==|\[\[|```|\\|<)")


def reassemble(lines: list[str], labels: list[int], fixes: dict[str, str], one_word: set[str]) -> str:
    """Continuous paragraphs from labelled lines: furniture dropped, split words joined, misread words put right.

    Blank lines, list items, headings and other structured lines keep their place. ``fixes``: misread
    word -> word meant; ``one_word``: the pairs that lose their hyphen.
    """
    out, broken = "", False
    for line, label in zip(lines, labels):
        if label >= HEADER:
            continue
        right, left = _RIGHT.match(line), _LEFT.search(out) if broken else None
        if not line.strip() or not out or out.endswith("\n") or _OWN_LINE.match(line):
            out += ("\n" if out else "") + line
        elif left and right and right.group(1)[0].islower():
            joined = out.rstrip()[-1] != "-" or f"{left.group(1)}-{right.group(1)}".lower() in one_word
            out = (out.rstrip()[:-1] if joined else out.rstrip()) + line.lstrip()
        else:
            out = out.rstrip() + " " + line.lstrip()
        broken = label == BREAK if line.strip() else broken

    def put_right(m: re.Match) -> str:
        word = m.group(0)
        meant = fixes.get(word.lower())
        return (meant.capitalize() if word[0].isupper() else meant) if meant else word

    return re.sub(r"[^\W_�]*(?:�[^\W_�]*)*", put_right, out) if fixes else out


def repaired(units: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_kind, record_id, block_id, text): the texts of :func:`scan_texts` put right.

    What a text needs (the words misread in it, the pairs it splits) is joined to it, one row per text.
    """
    keys = ["kind", "id", "block_id"]
    texts = scan_texts(units, pages)
    words, model = lexicon.Words(texts), learn_lines(texts)
    asked = line_noise(texts, model).where("pair IS NOT NULL").select(*keys, "pair")
    asked = materialize(asked)
    pairs = asked.join(words.joined(asked), "pair").select(*keys, "pair", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("meant"))
    misread = lexicon.with_misread(texts, words.bad, keys).select(*keys, F.lit(None).cast("string").alias("pair"), "word", "meant")
    fixes = F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "meant")))
    needs = pairs.unionByName(misread).groupBy(*keys).agg(F.collect_set("pair").alias("pairs"), fixes.alias("fixes"))
    joined = texts.join(needs.select(*[F.col(k).alias(f"n_{k}") for k in keys], "pairs", "fixes"), [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = Lines(pa.array(batch["text"], pa.string()))
            labels, at, out = model.label(lines, batch["place"].to_numpy()).tolist(), 0, []
            for text, pairs, fixes in zip(batch["text"], batch["pairs"], batch["fixes"]):
                own = text.split("\n")
                known = {f["word"]: f["meant"] for f in fixes} if fixes is not None else {}
                out.append(reassemble(own, labels[at : at + len(own)], known, set(pairs) if pairs is not None else set()))
                at += len(own)
            yield pd.DataFrame({"record_kind": batch["kind"], "record_id": batch["id"], "block_id": batch["block_id"], "text": out})

    return joined.select(*keys, "text", "place", "pairs", "fixes").mapInPandas(run, "record_kind string, record_id bigint, block_id int, text string")
