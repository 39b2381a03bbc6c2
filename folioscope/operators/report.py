"""Report formatting on small, already aggregated tables (the only place that collects)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def shown(value: object, decimals: int = 2) -> str:
    """A value for a table: ``-`` for none, no trailing zeros."""
    if value is None:
        return "-"
    if isinstance(value, float):
        text = f"{value:.{decimals}f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    return str(value)


def escaped(text: object) -> str:
    return "".join("\\" + c if c in "&%_#" else c for c in str(text))


def bold_best(rows: Sequence[Sequence], columns: Sequence[int], lower_is_better: Sequence[int] = ()) -> list[list[str]]:
    """Cells as text, the best of each metric column (and its equals) in bold."""
    best = {}
    for c in columns:
        numbers = [float(r[c]) for r in rows if isinstance(r[c], (int, float)) and not isinstance(r[c], bool)]
        if numbers:
            best[c] = min(numbers) if c in lower_is_better else max(numbers)
    cell = lambda c, v: rf"\textbf{{{shown(v)}}}" if c in best and isinstance(v, (int, float)) and abs(v - best[c]) < 1e-9 else shown(v)
    return [[cell(c, v) for c, v in enumerate(row)] for row in rows]


def latex_table(columns: Sequence[str], rows: Sequence[Sequence], caption: str, label: str, align: str | None = None) -> str:
    """A LaTeX table; string cells are taken as already formatted."""
    lines = [r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{align or 'l' + 'c' * (len(columns) - 1)}}}", r"\hline"]
    lines.append(" & ".join(escaped(c) for c in columns) + r" \\")
    lines.append(r"\hline")
    lines += [" & ".join(x if isinstance(x, str) else shown(x) for x in row) + r" \\" for row in rows]
    return "\n".join([*lines, r"\hline", r"\end{tabular}", r"\end{table}", ""])


def table_rows(df: DataFrame, columns: Sequence[str], most: int = 1000) -> list[list]:
    """The rows of an aggregated table; more than ``most`` is an error, not a cut."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table of more than {most} rows")
    return [list(r) for r in rows]


def fill_macros(source: str, values: dict[str, str]) -> str:
    r"""``\newcommand{\name}{value}`` lines set to new values; names not there yet are added at the end."""
    for name, value in values.items():
        head = rf"\newcommand{{\{name}}}"
        at = source.find(head)
        if at < 0:
            source = source.rstrip("\n") + f"\n{head}{{{value}}}\n"
            continue
        start = source.index("{", at + len(head))
        end = source.index("}", start)
        source = source[: start + 1] + value + source[end:]
    return source


def minutes(seconds: float | None) -> str:
    """``XmYs``."""
    whole = int(seconds or 0)
    return f"{whole // 60}m{whole % 60}s"
