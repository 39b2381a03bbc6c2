"""Queries of problem 4. The iteration has no SQL equal; see the tests for a brute-force version."""

from __future__ import annotations

from folioscope.llm import survivors


def _tables(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("units", "methods")]


def p4_found(spark, sf_dir):
    return survivors.surviving(*_tables(spark, sf_dir))


def p4_golden_records(spark, sf_dir):
    return survivors.golden_records(*_tables(spark, sf_dir))


def p4_reliabilities(spark, sf_dir):
    return survivors.reliabilities(*_tables(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_golden_records": p4_golden_records, "p4_reliabilities": p4_reliabilities}
ORACLE: dict[str, str] = {}
