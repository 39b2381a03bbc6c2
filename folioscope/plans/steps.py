"""Step interface: ``python -m folioscope.plans.steps STEP --in ... --out ...`` runs one step over Parquet tables.

Steps: normalize, rule_units, structure_units, process_pages, model_units, evaluate_v1, evaluate_v2, evaluate_blocks, tables.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators import evaluate, layout, match, page_model, tables
from folioscope.plans import pipelines
from folioscope.session import build_session, materialize


def _pages(df: DataFrame) -> DataFrame:
    return layout.latest_scans(df)


def evaluate_blocks(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return evaluate.evaluate_blocks(gold, pred, materialize(match.match_blocks(gold, pred, ["_doc_id", "_page_id"])))


#: Steps of one table (pages) and of two (gold units, predicted units).
ONE = {
    "normalize": lambda p: layout.normalize_pages(_pages(p)),
    "rule_units": lambda p: pipelines.rule_units(_pages(p)),
    "structure_units": lambda p: pipelines.structure_units(_pages(p)),
    "process_pages": lambda p: pipelines.process_pages(_pages(p))[0],
    "model_units": lambda p: page_model.model_units(_pages(p))[0],
}
TWO = {
    "evaluate_v1": lambda g, p: pipelines.evaluate(g, p, "v1"),
    "evaluate_v2": lambda g, p: pipelines.evaluate(g, p, "v2"),
    "evaluate_blocks": evaluate_blocks,
}


def system_tables(units: DataFrame, gold: str, methods: dict[str, str]) -> list[tables.Table]:
    """The main and the usability table of the methods (method -> name shown) against the gold units of a table of units."""
    systems = {}
    reference = units.where(units["method"] == gold)
    for method, name in methods.items():
        per_book = materialize(evaluate_blocks(reference, units.where(units["method"] == method)))
        systems[name] = tables.mean_over_books(per_book, sorted({*tables.MAIN, *tables.USABILITY}))
    return [tables.main_table(systems), tables.usability_table(systems)]


def run(spark: SparkSession, step: str, sources: list[str], out: str) -> None:
    """One step from Parquet to Parquet; ``tables`` writes text files of LaTeX, one row per table."""
    frames = [spark.read.parquet(s) for s in sources]
    if step in ONE:
        result = ONE[step](frames[0])
    elif step in TWO:
        result = TWO[step](*frames[:2])
    elif step == "tables":
        made = system_tables(frames[0], "gold", {"rule": "Rule-based", "llm": "LLM-only", "hybrid": "Hybrid baseline", "ours": "Ours"})
        result = spark.createDataFrame([(t.label, t.latex(), t.csv()) for t in made], "label string, latex string, csv string")
    else:
        raise ValueError(f"unknown step: {step}")
    result.write.mode("overwrite").parquet(out)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("step", choices=[*ONE, *TWO, "tables"])
    args.add_argument("--in", dest="sources", nargs="+", required=True)
    args.add_argument("--out", required=True)
    given = args.parse_args()
    run(build_session(), given.step, given.sources, given.out)


if __name__ == "__main__":
    main()
