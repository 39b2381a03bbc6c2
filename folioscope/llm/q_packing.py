"""Queries of problem 7. Packing has no SQL equal; see the tests for the invariants."""

from __future__ import annotations

from folioscope.llm import packing


def _tables(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "pack_sizes")]


def p7_packing(spark, sf_dir):
    return packing.packed_containers(*_tables(spark, sf_dir))


def p7_fill(spark, sf_dir):
    return packing.fill_report(packing.packed_containers(*_tables(spark, sf_dir)))


QUERIES = {"p7_packing": p7_packing, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
