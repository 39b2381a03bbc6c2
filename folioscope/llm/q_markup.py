"""Queries of problem 2; a host is a book. Markup paths are beyond SQL: no oracle, see the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.llm import markup
from folioscope.session import spread


def _texts(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/units.parquet").select(F.col("_doc_id").alias("host"), F.col("unit_id").alias("id"), F.col("content").alias("text")))


def p2_found(spark, sf_dir):
    return markup.markup_families(_texts(spark, sf_dir)).select(F.col("id").alias("unit_id"), F.col("family").alias("markup"))


def p2_clean(spark, sf_dir):
    return markup.clean_texts(_texts(spark, sf_dir)).withColumnRenamed("id", "unit_id")


def p2_path_votes(spark, sf_dir):
    return markup.path_votes(markup.scored_containers(_texts(spark, sf_dir)))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean, "p2_path_votes": p2_path_votes}
ORACLE: dict[str, str] = {}
