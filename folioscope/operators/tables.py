"""Report tables from evaluation results: rows as plain lists, to be shown by :mod:`report` or written as CSV.

Every input is aggregated already (a row per split, method or configuration); shares are shown in percent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import report

# What a method's units are called where they serve as input.
INPUTS = {"Rule-based": "Raw OCR / weak baseline", "LLM-only": "LLM-only theorem units", "Hybrid baseline": "Hybrid baseline", "Ours": "Proposed theorem units"}
CONFIGURATIONS = {"rule": "Rule (no norm, no LLM)", "hybrid": "Rule + LLM repair (Hybrid)", "ours_no_llm": "Norm + Rule (no LLM)", "ours": "Norm + Rule + LLM (Ours)"}
DATASET = ("split", "pages", "ocr_blocks", "theorem_units", "definitions", "theorem_like", "examples", "avg_blocks_per_unit", "avg_formulas_per_unit", "multi_block_unit_ratio")
MAIN = ("boundary_precision", "boundary_recall", "boundary_f1", "unit_type_accuracy", "formula_attachment_accuracy", "statement_completeness", "normalized_edit_distance", "formalization_readiness")
USABILITY = ("structured_parse_success", "symbol_stability", "retrieval_compatibility", "formalization_readiness")
FACTORS = ("boundary_f1", "unit_type_accuracy", "formula_attachment_accuracy", "statement_completeness", "formalization_readiness")


class Table:
    """Columns, rows and what a LaTeX table needs besides."""

    def __init__(self, columns: Sequence[str], rows: list[list], caption: str, label: str):
        self.columns, self.rows, self.caption, self.label = list(columns), rows, caption, label

    def latex(self, bold: Sequence[int] = (), lower_is_better: Sequence[int] = ()) -> str:
        rows = report.bold_best(self.rows, bold, lower_is_better) if bold else self.rows
        return report.latex_table(self.columns, rows, self.caption, self.label)

    def csv(self) -> str:
        quote = lambda v: '"' + str(v).replace('"', '""') + '"' if any(c in str(v) for c in ',"\n') else str(v)
        return "\n".join(",".join("" if v is None else quote(v) for v in row) for row in [self.columns, *self.rows]) + "\n"


def percent(value: float | None, digits: int = 2) -> float | None:
    return None if value is None else round(value * 100, digits)


def macro_values(total: dict, scores: dict[str, float], agreement: dict) -> dict[str, str]:
    """Names and values of the text macros a report shows; shares in percent. The names."""
    share = lambda v: report.shown(percent(v))
    return {
        "TWOBOUNDARYFONE": share(scores["boundary_f1"]),
        "TWOFORMULAACC": share(scores["formula_attachment_accuracy"]),
        "TWOCOMPLETENESS": share(scores["statement_completeness"]),
        "TWOREADINESS": share(scores["formalization_readiness"]),
        "TOTALPAGES": str(total["pages"]),
        "TOTALBLOCKS": str(total["ocr_blocks"]),
        "TOTALUNITS": str(total["theorem_units"]),
        "MULTIBLOCKRATIO": report.shown(percent(total["multi_block_unit_ratio"], 1)),
        "DOUBLEPAGES": str(agreement["pages"]),
        "BOUNDARYAGREE": share(agreement["boundary"]),
        "TYPEAGREE": share(agreement["type"]),
        "FORMULAAGREE": share(agreement["formula"]),
    }


def mean_over_books(per_book: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Means of a per-book result, one row to the driver."""
    row = per_book.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def dataset_table(summary: DataFrame, pages: DataFrame) -> Table:
    """Splits and the whole (split NULL) with pages and blocks. ``pages``: (split, pages, ocr_blocks), the whole included."""
    joined = summary.join(pages.withColumnRenamed("split", "s"), F.col("split").eqNullSafe(F.col("s")), "left").drop("s")
    rows = report.table_rows(joined.orderBy(F.col("split").isNull(), "split"), DATASET)
    shown = [[(r[0] or "total").capitalize(), *(round(v, 2) if isinstance(v, float) else v for v in r[1:])] for r in rows]
    return Table(DATASET, shown, "Statistics of the dataset.", "tab:dataset")


def main_table(systems: dict[str, dict[str, float]]) -> Table:
    """A row per system: block-form scores in percent, the edit distance as it is."""
    rows = [[name, *(round(m[c], 4) if c == "normalized_edit_distance" else percent(m[c]) for c in MAIN)] for name, m in systems.items()]
    return Table(("method", *MAIN), rows, "Quality of the theorem units.", "tab:main_results")


def usability_table(systems: dict[str, dict[str, float]]) -> Table:
    rows = [[INPUTS.get(name, name), *(percent(m[c]) for c in USABILITY)] for name, m in systems.items()]
    return Table(("input_representation", *USABILITY), rows, "Downstream usability.", "tab:downstream")


def factor_table(variants: dict[str, dict[str, float]]) -> Table:
    """A row per variant of the system, the full one first."""
    return Table(("variant", *FACTORS), [[name, *(percent(m[c]) for c in FACTORS)] for name, m in variants.items()], "Factor analysis.", "tab:ablation")


def ablation_table(configurations: dict[str, dict[str, float]]) -> Table:
    """Configurations of the pipeline by boundary F1 and downstream scores of the label-level family."""
    rows = [[CONFIGURATIONS.get(name, name), *(percent(m[c], 1) for c in ("f1", "parse", "symbol", "retrieval", "ready"))] for name, m in configurations.items()]
    return Table(("configuration", "boundary_f1", "parse", "symbol", "retrieval", "ready"), rows, "Ablation.", "tab:configurations")


def error_table(counts: DataFrame) -> Table:
    """Kinds of errors as rows, methods as columns."""
    rows = {r[0]: r[1:] for r in report.table_rows(counts.orderBy("method"), ("method", "fn", "fp", "lost", "parse_errors", "symbol_errors"))}
    names = ("Boundary FN (missed)", "Boundary FP (extra)", "Remaining U+FFFD chars", "Units w/ parse errors", "Units w/ symbol errors")
    return Table(("metric", *rows), [[name, *(v[i] for v in rows.values())] for i, name in enumerate(names)], "Error analysis.", "tab:errors")


def cost_table(costs: DataFrame) -> Table:
    """Calls, tokens and time per method; a method without calls has no time of its own."""
    rows = report.table_rows(costs.orderBy("method"), ("method", "calls", "prompt_tokens", "completion_tokens", "total_tokens", "seconds"))
    return Table(("method", "llm_calls", "prompt_tokens", "completion_tokens", "total_tokens", "wall_time"), [[*r[:5], report.minutes(r[5]) if r[5] else "N/A"] for r in rows], "Computational cost.", "tab:cost")


def descriptive_table(stats: DataFrame, key: str = "split") -> Table:
    columns = (key, "avg_tokens_per_unit", "avg_formulas_per_unit", "detached_heading_ratio", "proof_adjacent_ratio", "avg_ocr_confidence")
    rows = report.table_rows(stats.orderBy(F.col(key).isNull(), key), columns)
    digits = (1, 1, 3, 3, 2)
    return Table(columns, [[r[0] or "total", *(0.0 if v is None else round(v, n) for v, n in zip(r[1:], digits))] for r in rows], "Descriptive statistics of the units.", "tab:descriptive_stats")
