"""Queries of problem 6. Line labelling is beyond SQL: see the tests for planted noise."""

from __future__ import annotations

from folioscope.llm import scans
from folioscope.session import spread


def _tables(spark, sf_dir):
    units = spark.read.parquet(f"{sf_dir}/units.parquet").select("unit_id", "content")
    pages = spark.read.parquet(f"{sf_dir}/ocr_pages.parquet").select("scan_id", "page_height", "blocks")
    return [spread(units), spread(pages)]


def p6_found(spark, sf_dir):
    return scans.scan_noise(*_tables(spark, sf_dir))


def p6_repaired(spark, sf_dir):
    return scans.repaired(*_tables(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
ORACLE: dict[str, str] = {}
