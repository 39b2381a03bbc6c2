"""Repairs by an outside model, behind a client protocol.

A client is a callable ``(prompt: str) -> str`` made on the executor by ``make_client``; here the
default answers from a rule, so runs need no network. Rows that need no repair never reach Python.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

FIXES = "array<struct<id:int,char:string>>"
EDITS = "array<struct<find:string,replace:string>>"


def offline_client() -> Callable[[str], str]:
    """Answers every request with an empty list."""
    return lambda prompt: "[]"


def ask(requests: DataFrame, make_client: Callable[[], Callable[[str], str]] = offline_client, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, answer, attempts, seconds, prompt_tokens, completion_tokens) for (key, prompt). Failures are tried again with doubled waits, then NULL.

    A client answers with a text, or with (text, prompt tokens, completion tokens); unknown counts are NULL.

    Calls have effects outside Spark: write the result before using it twice, keyed by its request.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["key"], batch["prompt"]):
                began, answer, attempt = time.time(), None, 0
                while answer is None and attempt < tries:
                    attempt += 1
                    try:
                        answer = client(prompt)
                    except Exception:
                        if attempt < tries:
                            time.sleep(wait * 2 ** (attempt - 1))
                text, asked, given = answer if isinstance(answer, tuple) else (answer, None, None)
                rows.append((key, text, attempt, time.time() - began, asked, given))
            yield pd.DataFrame(rows, columns=["key", "answer", "attempts", "seconds", "prompt_tokens", "completion_tokens"]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    return requests.select("key", "prompt").mapInPandas(run, "key string, answer string, attempts int, seconds double, prompt_tokens bigint, completion_tokens bigint")


def symbol_requests(units: DataFrame, window: int = 30) -> DataFrame:
    """(key, prompt): one request per unit and field that has lost characters, with their contexts."""
    fields = units.select("unit_id", F.explode(F.create_map(F.lit("content"), F.col("content"), F.lit("proof"), F.col("proof"))).alias("field", "value")).where(F.col("value").contains(T.LOST))
    return fields.select(F.concat_ws("/", F.col("unit_id").cast("string"), "field").alias("key"), F.to_json(T.repair_contexts(F.col("value"), window)).alias("prompt"))


def apply_symbol_answers(units: DataFrame, answers: DataFrame) -> DataFrame:
    """Units with the characters of the answers put in place; unanswered ones stay as they are."""
    fixes = F.from_json(T.json_array(F.col("answer")), FIXES)
    parsed = answers.where("answer IS NOT NULL").select(F.split("key", "/")[0].cast("bigint").alias("unit_id"), F.split("key", "/")[1].alias("field"), F.map_from_entries(F.array_distinct(F.transform(F.filter(fixes, lambda f: f["id"].isNotNull()), lambda f: F.struct((f["id"] - 0).alias("k"), f["char"].alias("v"))))).alias("m"))
    per = parsed.groupBy("unit_id").agg(*[F.any_value(F.when(F.col("field") == f, F.col("m")), True).alias(f"m_{f}") for f in ("content", "proof")])
    out = units.join(per, "unit_id", "left")
    for f in ("content", "proof"):
        out = out.withColumn(f, F.when(F.col(f"m_{f}").isNotNull(), T.apply_at(F.col(f), F.col(f"m_{f}"))).otherwise(F.col(f))).drop(f"m_{f}")
    return out


def batches(units: DataFrame, size: int = 8, book: str = "_doc_id", order: str = "unit_id") -> DataFrame:
    """Damaged units numbered into batches of ``size`` per book, in order."""
    damaged = units.where(F.col("content").contains(T.LOST) | F.col("proof").contains(T.LOST))
    return damaged.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(book).orderBy(order)) - 1) / size).cast("int"))


def batch_requests(units: DataFrame, size: int = 8, book: str = "_doc_id") -> DataFrame:
    """(key, prompt) per batch: label, content and proof of its units."""
    packed = batches(units, size, book).groupBy(book, "batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct("unit_id", "label", "content", "proof")))).alias("prompt"))
    return packed.select(F.concat_ws("/", book, F.col("batch").cast("string")).alias("key"), "prompt")


def apply_edits(units: DataFrame, edits: DataFrame, book: str = "_doc_id") -> DataFrame:
    """Units with (book, label, fixes) find-and-replace edits, first occurrence only, in content then proof; ``hits`` counts.

    Of repeated labels in ``edits`` the last counts.
    """
    one = edits.groupBy(book, "label").agg(F.max_by("fixes", "seq").alias("fixes"))
    done = units.join(one, [book, "label"], "left").withColumn("fixes", F.coalesce("fixes", F.from_json(F.lit("[]"), EDITS)))
    done = done.withColumn("c", T.apply_once(F.col("content"), F.col("fixes"))).withColumn("q", T.apply_once(F.col("proof"), F.col("fixes")))
    return done.withColumn("content", F.col("c.text")).withColumn("proof", F.col("q.text")).withColumn("hits", F.col("c.hits") + F.col("q.hits")).drop("c", "q", "fixes")


def usage(stats: DataFrame, method: str, price_note: str = "") -> str:
    """One line of usage as JSON, for a report."""
    row = stats.where(F.col("method") == method).agg(F.sum("llm_calls").alias("calls"), F.sum("total_tokens").alias("tokens")).first()
    return json.dumps({"method": method, "calls": row["calls"] or 0, "tokens": row["tokens"] or 0, "note": price_note})
