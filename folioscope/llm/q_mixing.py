"""Queries of problem 8. The fit has no SQL equal; see the tests for shares and repeats."""

from __future__ import annotations

from folioscope.llm import mixing
from folioscope.session import materialize


def _tables(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "mix_targets")]


def p8_mixture(spark, sf_dir):
    return mixing.mixture(*_tables(spark, sf_dir))


def p8_reached_shares(spark, sf_dir):
    documents, targets = _tables(spark, sf_dir)
    return mixing.reached_shares(materialize(mixing.mixture(documents, targets)), targets)


def p8_fit(spark, sf_dir):
    return mixing.fit_report(*_tables(spark, sf_dir))


QUERIES = {"p8_mixture": p8_mixture, "p8_reached_shares": p8_reached_shares, "p8_fit": p8_fit}
ORACLE: dict[str, str] = {}
