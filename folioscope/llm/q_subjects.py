"""Queries of problem 9. Propagation has no SQL equal; see the tests for held-out accuracy."""

from __future__ import annotations

from folioscope.llm import subjects


def _tables(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "subject_areas", "subject_labels")]


def p9_found(spark, sf_dir):
    return subjects.document_subjects(*_tables(spark, sf_dir)).select("doc_id", "subject")


def p9_make_up(spark, sf_dir):
    return subjects.corpus_make_up(*_tables(spark, sf_dir))


def p9_propagation(spark, sf_dir):
    return subjects.propagation_report(*_tables(spark, sf_dir))


QUERIES = {"p9_found": p9_found, "p9_make_up": p9_make_up, "p9_propagation": p9_propagation}
ORACLE: dict[str, str] = {}
