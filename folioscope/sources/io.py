"""Readers and writers of the file forms in use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """OCR pages (``p*.json``, one object per file; manifests beside them are not read), with chapter and number from the path.

    The blocks are the first of the known containers; their type is ``block_type``. A block without an id goes by its
    place in the container. No chapter in the path: 1.
    """
    raw = spark.read.schema(schemas.PAGE).option("multiLine", True).option("pathGlobFilter", "p*.json").option("recursiveFileLookup", True).json(path)
    file = F.col("_metadata.file_path")
    renamed = lambda b, i: F.struct(F.coalesce(b["block_id"], i).alias("block_id"), b["type"].alias("block_type"), b["text"].alias("text"), b["bbox"].alias("bbox"), b["font_size"].alias("font_size"), b["is_bold"].alias("is_bold"))
    number = F.regexp_extract(file, r"Chapter(\d+)", 1)
    return raw.select("doc_id", F.coalesce("page_id", F.regexp_extract(file, r"([^/]+)\.json$", 1)).alias("page_id"), "page_index", "page_width", "page_height", F.transform(F.coalesce("blocks", "items", "layout_blocks", "elements"), renamed).alias("blocks"), F.when(number == "", 1).otherwise(number.try_cast("int")).alias("chapter"))


def read_units(spark: SparkSession, path: str, form: str = "env") -> DataFrame:
    """Units: ``env`` form from JSON arrays, ``block`` form from JSON lines (blank lines are skipped)."""
    if form == "env":
        return spark.read.schema(schemas.UNIT_ENV).option("multiLine", True).json(path)
    return spark.read.schema(schemas.UNIT_BLOCK).json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW_ANSWER).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = schemas.ANNOTATION) -> DataFrame:
    """A CSV with header, all text; quoted fields may hold line ends."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_page_ids(spark: SparkSession, path: str) -> DataFrame:
    """(page_id): one per line, blanks off, each once."""
    return spark.read.text(path).select(F.trim("value").alias("page_id")).where("page_id <> ''").distinct()


def read_pdfs(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Raw blocks of PDF files by a decoder given by the caller (none is built in).

    ``decode`` yields dicts of ``schema``'s columns from a file's bytes; see ``layout.assemble_page`` for what follows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(decode(bytes(content))))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("content").mapInPandas(run, schema)


def read_settings(text: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines; values of the environment win. Comments and blank lines are skipped."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs} | (environment or {})


def write_json_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One file with one JSON array, for results of at most ``most`` rows (more is an error, not a cut), in the order of the frame.

    Larger results go out as JSON lines (:func:`write_jsonl`), a file per partition.
    """
    rows = [r["j"] for r in df.select(F.to_json(F.struct("*")).alias("j")).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a JSON array of more than {most} rows")
    text = "[\n" + ",\n".join(rows) + "\n]"
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_stats(df: DataFrame, path: str) -> None:
    """Run statistics (RUN_STATS and a doc_id) as JSON lines, a folder per method; totals missing are the sum of the parts."""
    whole = F.coalesce("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    df.withColumn("total_tokens", whole).write.mode("overwrite").partitionBy("method").json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """``one_file`` for report tables only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)
