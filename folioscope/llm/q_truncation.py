"""Queries of problem 5. The hazard test has no SQL equal; see the tests for planted cuts."""

from __future__ import annotations

from folioscope.llm import truncation


def _units(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/units.parquet")


def p5_found(spark, sf_dir):
    return truncation.cut_values(_units(spark, sf_dir))


def p5_cut_rates(spark, sf_dir):
    return truncation.cut_rates(_units(spark, sf_dir))


def p5_length_limits(spark, sf_dir):
    return truncation.significant_lengths(truncation.field_values(_units(spark, sf_dir)))


QUERIES = {"p5_found": p5_found, "p5_cut_rates": p5_cut_rates, "p5_length_limits": p5_length_limits}
ORACLE: dict[str, str] = {}
