"""Small result tables as text for reports: Markdown, LaTeX and plain columns. They are collected, so hand in bounded ones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def _cell(x, digits: int) -> str:
    if x is None:
        return "-"
    if isinstance(x, float):
        return ("inf" if x > 0 else "-inf") if math.isinf(x) else f"{x:.{digits}f}"
    return str(x)


def cells(rows: DataFrame, digits: int = 4) -> list[list[str]]:
    return [[_cell(x, digits) for x in r] for r in rows.collect()]


def markdown(rows: DataFrame, digits: int = 4) -> str:
    line = lambda xs: "| " + " | ".join(x.replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(rows.columns), "|" + "-|" * len(rows.columns), *map(line, cells(rows, digits))]) + "\n"


def latex(rows: DataFrame, digits: int = 4) -> str:
    special = {c: f"\\{c}" for c in "&%$#_{}"}
    line = lambda xs: " & ".join("".join(special.get(c, c) for c in x) for x in xs) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", line(rows.columns), r"\hline", *map(line, cells(rows, digits)), r"\end{tabular}"]) + "\n"


def columns(rows: DataFrame, digits: int = 6) -> str:
    """Blank-separated columns under their names, as plotting programs read them."""
    return "\n".join(" ".join(x.replace(" ", "_") for x in xs) for xs in [rows.columns, *cells(rows, digits)]) + "\n"
