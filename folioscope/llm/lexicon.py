"""Corpus lexicon and misread words.

Word counts cover all texts; they are taken in Arrow batches, so only distinct words are shuffled. A
word is misread if undoing scan confusions leads to a word many times as frequent. The words it may
have been are found by an equi-join: words that the confusions can turn into each other share a
skeleton, so no list of words is ever held by one process and there is no limit on sites or letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from folioscope.session import materialize, small_enough

LOST = "�"
# What a scan makes of letters -> the letters it may have been.
CONFUSED = {"0": "o", "1": "li", "5": "s", "9": "g", "6": "b", "8": "b", "3": "e", "4": "a", "7": "t", "c": "e", "b": "h", "ii": "u", "rn": "m", "cl": "d", "vv": "w", "li": "h", "|": "l"}

_INVISIBLE = r"[\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]"
# Between words: all but Latin, Greek and Cyrillic letters, their full-width forms, digits, hyphens and lost characters.
_BETWEEN = "[^-\x1f0-9A-Za-zÀ-ɏͰ-ԯḀ-῿０-ｚ�]+"
# A word split over a line end, and a first half whose second does not follow at once.
_SPLIT_AT_END = "([0-9\\pL�]*)[-‐\\x{ad}¬][ \t]*\n\\s*([0-9�]*\\pL[0-9\\pL�]*)"
_HALF_AT_END = "[0-9\\pL�]*[-‐\\x{ad}¬][ \t]*\n"
#: Stands before a word put together from its halves at two line ends, which may be a compound without its hyphen.
_PUT = "\x1f"
# A word that may be misread or ordinary: Latin letters, digits and lost characters, at least one small letter.
_WORD = "^[0-9a-zà-ÿĀ-ɏ�]*[a-zà-ÿĀ-ɏ][0-9a-zà-ÿĀ-ɏ�]*$"
_LETTERS = "^[a-zà-ÿĀ-ɏ]{2,}$"
_SUSPECT = "[0-9cb�]|ii|rn|vv|li"


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, compounds with their hyphens; words split over a line end are put together behind a mark,
    first halves without a second are left out."""
    joined = pc.replace_substring_regex(texts.cast(pa.string()), _SPLIT_AT_END, f" {_PUT}\\1\\2 ")
    joined = pc.replace_substring_regex(joined, _HALF_AT_END, "\n")
    return pc.split_pattern_regex(pc.replace_substring_regex(joined, _INVISIBLE, ""), _BETWEEN)


def _parts(word: str) -> list[str]:
    """A compound's parts, or the word itself."""
    return [p for p in word.replace(_PUT, "").split("-") if p]


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n, small, put) over all texts, in small letters; ``small`` is how often a word was written so, whole and
    in one line, ``put`` how often it was put together from halves.

    Words have two or more Latin letters, digits and lost characters; a compound counts as itself
    (with its hyphens) and for its parts. Counted per batch first, so only distinct words are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = pc.value_counts(split_words(batch.column(0)).flatten())
            words, n = counted.field(0), counted.field(1)
            hyphen = pc.match_substring_regex(words, f"[-{_PUT}]")
            plain = pc.invert(hyphen)
            more_words, more_n = [], []
            for w, k in zip(words.filter(hyphen).to_pylist(), n.filter(hyphen).to_pylist()):
                parts = _parts(w)
                # A word put together keeps its mark here.
                names = [_PUT + p for p in parts] if w.startswith(_PUT) else parts + ["-".join(parts)] if len(parts) > 1 else parts
                more_words += names
                more_n += [k] * len(names)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.filter(plain).cast(pa.string()), pa.array(more_words, pa.string())]), pa.concat_arrays([n.filter(plain), pa.array(more_n, pa.int64())])], names=["w", "n"])

    counted = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).mapInArrow(run, "w string, n bigint").where(F.length("w") >= 2)
    put = F.col("w").startswith(_PUT)
    bare = F.when(put, F.substr("w", F.lit(2))).otherwise(F.col("w"))
    marked = counted.select(bare.alias("w"), "n", put.alias("put")).where(F.length("w") >= 2)
    word = F.lower("w")
    own = (F.col("w") == word) & ~F.col("put")
    sums = marked.groupBy(word.alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("small"), F.sum(F.when(F.col("put"), F.col("n")).otherwise(0)).alias("put"))
    return sums.where(F.col("word").rlike(_WORD) | F.col("word").contains("-"))


def ordinary_words(counts: DataFrame, least: int = 5) -> DataFrame:
    """(word, n): the words of letters that are written small ``least`` times or more, whatever the size of the corpus."""
    return counts.where(F.col("word").rlike(_LETTERS) & (F.col("small") >= least)).select("word", "n")


def skeleton(word: Column) -> Column:
    """What stays of a word when no scan confusion can matter: a misread word and the word meant have the same one.

    Letters that a pair may stand for are written as the pair, and each class of single look-alikes as one letter.
    """
    out = word
    for letter in "hb68":
        out = F.replace(out, F.lit(letter), F.lit("li"))
    for letter, pair in (("m", "rn"), ("u", "ii"), ("d", "cl"), ("w", "vv")):
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.translate(out, "i1|e305947", "lllccosgat")


def undone(word: str, target: str) -> int | None:
    """The fewest confusions undone that make ``target`` of ``word``, None if none do. A lost character stands for any letter."""
    # reach[i]: place in ``target`` after i characters of ``word`` -> fewest sites undone.
    reach: list[dict[int, int]] = [{} for _ in range(len(word) + 2)]
    reach[0][0] = 0

    def keep(i: int, at: int, n: int) -> None:
        reach[i][at] = min(n, reach[i].get(at, n))

    for i, c in enumerate(word):
        for at, n in reach[i].items():
            if at == len(target):
                continue
            t, two = target[at], word[i : i + 2]
            if c == t or c == LOST:
                keep(i + 1, at + 1, n)
            if t in CONFUSED.get(c, ""):
                keep(i + 1, at + 1, n + 1)
            if len(two) == 2 and CONFUSED.get(two) == t:
                keep(i + 2, at + 1, n + 1)
    return reach[len(word)].get(len(target))


@F.pandas_udf(IntegerType())
def _undone(word: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([undone(w, t) for w, t in zip(word, target)], dtype="Int64")


def misread_words(counts: DataFrame, ratio: float = 20.0) -> DataFrame:
    """(word, meant) of the distinct words that are misread, in small letters.

    Candidates share the skeleton; for a word with one lost character, the skeleton with any letter in
    its place; with several, the length and the first two known letters. A candidate must be ``ratio``
    times as frequent, for a word with digits as frequent; a word with lost characters may be any,
    the one with the fewest other sites undone, then the most frequent.
    """
    known = ordinary_words(counts)
    suspect = counts.where(F.col("word").rlike(_SUSPECT) & F.col("word").rlike(_WORD)).select("word", "n")
    suspect = suspect.withColumn("lost", F.length("word") - F.length(F.replace("word", F.lit(LOST), F.lit("")))).where(F.length("word") - F.col("lost") >= 2)
    targets = known.select(F.col("word").alias("meant"), F.col("n").alias("m"))
    whole = suspect.where("lost = 0").withColumn("key", skeleton(F.col("word")))
    letters = F.array(*[F.lit(x) for x in sorted(set("acfgjklnopqrstvxyz"))] + [F.lit(x) for x in ("ll", "rn", "cl", "vv")])
    one = suspect.where("lost = 1").withColumn("letter", F.explode(letters)).withColumn("key", F.replace(skeleton(F.col("word")), F.lit(LOST), F.col("letter"))).drop("letter")
    by_skeleton = whole.unionByName(one).join(targets.withColumn("key", skeleton(F.col("meant"))), "key").drop("key")
    # Several lost characters: nothing else but digits may be misread, so the length stays.
    spots = F.filter(F.transform(F.split("word", ""), lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda s: ~s["c"].rlike("[0-9�]"))
    several = suspect.where("lost > 1").withColumn("spots", spots).where(F.size("spots") >= 2)
    several = several.select("word", "n", "lost", F.struct(F.length("word").alias("size"), F.col("spots")[0].alias("a"), F.col("spots")[1].alias("b")).alias("key"))
    at = F.transform(F.split("meant", ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    pairs = F.flatten(F.transform(at, lambda a: F.transform(F.filter(at, lambda b: b["i"] > a["i"]), lambda b: F.struct(F.length("meant").alias("size"), a.alias("a"), b.alias("b")))))
    spread = targets.join(several.select(F.length("word").alias("size")).distinct(), F.length("meant") == F.col("size"), "left_semi").select("meant", "m", F.explode(pairs).alias("key"))
    by_letters = several.join(spread, "key").drop("key")
    digits = F.col("word").rlike("[0-9]")
    rated = by_skeleton.unionByName(by_letters).where("word <> meant").distinct().withColumn("sites", _undone("word", "meant")).where("sites IS NOT NULL")
    rated = rated.where((F.col("lost") > 0) | (F.col("m") >= F.when(digits, 1.0).otherwise(ratio) * F.col("n")))
    # Two letters and a digit are a symbol's name more often than a word: those need the full ratio.
    rated = rated.where(~digits | (F.length("word") > 2) | (F.col("m") >= ratio * F.col("n")))
    best = F.max_by("meant", F.struct(F.when(F.col("lost") > 0, -F.col("sites")).otherwise(0), F.col("m"), F.col("meant")))
    return rated.groupBy("word").agg(best.alias("meant"))


class Words:
    """The vocabulary of a corpus, both parts materialized: ``counts`` (word, n, small) and ``bad`` (word, meant)."""

    def __init__(self, texts: DataFrame, column: str = "text"):
        self.counts = materialize(word_counts(texts, column))
        self.bad = materialize(misread_words(self.counts))

    def joined(self, pairs: DataFrame) -> DataFrame:
        """(pair): those of the distinct ``pairs`` (``left-right``) that are one word split over a line end.

        A pair that the corpus writes with its hyphen inside a line more often than as one word is a compound.
        """
        seen = self.counts.select("word", (F.col("n") - F.col("put")).alias("n"))
        asked = pairs.select("pair").distinct()
        as_one = seen.select(F.col("word").alias("whole"), F.col("n").alias("ones"))
        as_two = seen.where(F.col("word").contains("-")).select(F.col("word").alias("pair"), F.col("n").alias("twos"))
        rated = asked.withColumn("whole", F.replace("pair", F.lit("-"), F.lit(""))).join(as_two, "pair", "left").join(as_one, "whole", "left")
        return rated.where(F.coalesce("ones", F.lit(0)) >= F.coalesce("twos", F.lit(0))).select("pair")


def words_in(batch: pa.Array, wanted: frozenset[str] | None) -> Iterator[tuple[int, str]]:
    """(row, word) of the ``wanted`` words in the texts, in small letters; of every suspect word if None."""
    words = split_words(batch)
    coded = words.flatten().dictionary_encode()
    hits: list[list[str]] = []
    suspect = re.compile(_SUSPECT)
    for w in coded.dictionary.to_pylist():
        parts = _parts(w.lower()) if w else []
        hits.append([p for p in parts if (p in wanted if wanted is not None else len(p) >= 2 and suspect.search(p))])
    some = pa.array([bool(h) for h in hits], pa.bool_())
    if not len(some) or not pc.any(some).as_py():
        return
    mask = some.take(coded.indices)
    rows = pc.list_parent_indices(words).filter(mask).to_pylist()
    for row, code in zip(rows, coded.indices.filter(mask).to_pylist()):
        for word in hits[code]:
            yield row, word


def with_misread(texts: DataFrame, bad: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys, word, meant): a row for each misread word in each text (as often as it stands there).

    ``bad`` (materialized) goes to the workers if its size is proven small; else the suspect words of
    the texts are joined with it.
    """
    small = small_enough(bad)
    wanted = frozenset(r["word"] for r in bad.select("word").collect()) if small else None
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "word"]
        for batch in batches:
            found = list(words_in(batch.column(len(keys)), shared.value))
            rows = pa.array([r for r, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[: len(keys)]), pa.array([w for _, w in found], pa.string())], names=names)

    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keys), "word string"])
    return texts.select(*keys, F.col(column).alias("__text")).where(F.col("__text").isNotNull()).mapInArrow(run, schema).join(bad, "word")
