"""Units from pages by an outside model: which pages are asked, what is asked, and what the answers give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import json_array, strip
from folioscope.operators import repair
from folioscope.operators.segment import SECTION_PARTS
from folioscope.session import materialize

# Words of which a page must hold one to be asked for.
PAGE_WORDS = ("definition", "theorem", "lemma", "corollary", "proposition", "remark", "example", "exercise", "proof")
UNIT = (
    "struct<label:string,env:string,number_components:array<int>,content:string,dependencies:array<string>,proof:string,"
    "context:struct<chapter_number:int,section:string,section_number:int>,_source_blocks:array<int>,_proof_blocks:array<int>>"
)
SYSTEM = "You find numbered statements (definitions, theorems, lemmas, propositions, corollaries, examples, remarks, exercises) on the page of a textbook and answer with a JSON array only."
REQUEST = (
    "Page {page} of {book}, chapter {chapter}, section {number} ({section}). The blocks of the page follow as JSON. Give one object per statement with label, env, "
    "number_components, content, proof, dependencies, context, _source_blocks and _proof_blocks; leave out what is not there and change no wording.\n{blocks}"
)


def has_unit_words(blocks: Column) -> Column:
    """Whether any block of a page holds one of PAGE_WORDS, anywhere and in any case."""
    return F.exists(F.coalesce(blocks, F.array()), lambda b: F.lower(F.coalesce(b["text"], F.lit(""))).rlike("|".join(PAGE_WORDS)))


def simple_blocks(blocks: Column) -> Column:
    """array<struct<block_id, type, text>>: what a model needs to see of the blocks."""
    return F.transform(blocks, lambda b: F.struct(b["block_id"].alias("block_id"), F.coalesce(b["block_type"], F.lit("text")).alias("type"), F.coalesce(b["text"], F.lit("")).alias("text")))


def carry_asked_section(pages: DataFrame) -> DataFrame:
    """``pages`` with the section and number in force at each: the last heading block of the pages asked so far in the book, its own included.

    Pages that are not asked neither set nor change it. The window runs over pages, one row each.
    """
    line = lambda b: strip(b["text"])
    heads = F.filter(F.coalesce("blocks", F.array()), lambda b: (b["block_type"] == "heading") & line(b).rlike(SECTION_PARTS))
    last = F.element_at(heads, -1)
    found = F.when(has_unit_words(F.col("blocks")) & (F.size(heads) > 0), F.struct(F.regexp_extract(line(last), SECTION_PARTS, 3).alias("section"), F.regexp_extract(line(last), SECTION_PARTS, 2).cast("int").alias("number")))
    so_far = Window.partitionBy("doc_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)
    headed = pages.withColumn("__heading", F.last(found, ignorenulls=True).over(so_far))
    return headed.withColumn("section", F.coalesce("__heading.section", F.lit(""))).withColumn("section_number", F.coalesce("__heading.number", F.lit(0))).drop("__heading")


def page_requests(pages: DataFrame) -> DataFrame:
    """(key, prompt) of the pages asked; ``pages`` has one scan per page and may have a ``chapter``."""
    asked = carry_asked_section(pages).where((F.size("blocks") > 0) & has_unit_words(F.col("blocks")))
    chapter = F.col("chapter").cast("string") if "chapter" in pages.columns else F.lit("1")
    parts = {"page": F.col("page_id"), "book": F.col("doc_id"), "chapter": chapter, "number": F.col("section_number").cast("string"), "section": F.col("section"), "blocks": F.to_json(simple_blocks(F.col("blocks")))}
    prompt = F.lit(SYSTEM + "\n\n" + REQUEST)
    for name, value in parts.items():
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return asked.select(F.concat_ws("/", "doc_id", "page_id").alias("key"), prompt.alias("prompt"))


def answered_units(answers: DataFrame) -> DataFrame:
    """(doc_id, page_id, seq, unit fields) of (key, answer): the objects of each answer's JSON array, none where it can't be read."""
    parsed = answers.where("answer IS NOT NULL").select(F.split("key", "/")[0].alias("doc_id"), F.split("key", "/")[1].alias("page_id"), F.posexplode(F.from_json(json_array(F.col("answer")), f"array<{UNIT}>")).alias("seq", "u"))
    return parsed.where("u IS NOT NULL").select("doc_id", "page_id", "seq", "u.*")


def merged_units(units: DataFrame) -> DataFrame:
    """One unit per label and book (an empty label is one like any other): the longest content, the first of equals; numbered by number components."""
    first = Window.partitionBy("doc_id", "label").orderBy(F.length(F.coalesce("content", F.lit(""))).desc(), "page_id", "seq")
    kept = units.withColumn("label", F.coalesce("label", F.lit(""))).withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    numbers = F.coalesce("number_components", F.array(F.lit(0)))
    return kept.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy(numbers, "page_id", "seq")))


def model_units(pages: DataFrame, make_client: Callable = repair.offline_client) -> tuple[DataFrame, DataFrame]:
    """(units, usage per book): every asked page is one request. The answers are written once before use."""
    answers = materialize(repair.ask(page_requests(pages), make_client))
    usage = answers.groupBy(F.split("key", "/")[0].alias("doc_id")).agg(
        F.count(F.lit(1)).alias("llm_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("total_tokens"), F.sum("seconds").alias("wall_time_seconds"),
    )
    return merged_units(answered_units(answers)), usage
