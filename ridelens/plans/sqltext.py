"""Small helpers that write DuckDB SQL text for the oracle queries."""

from __future__ import annotations

from collections.abc import Sequence

INF = float("inf")


def pr(expr: str, digits: int) -> str:
    """Half-even rounding, the SQL twin of ``functions.pround``."""
    scale = 10**digits
    return f"(round_even(({expr}) * {scale}.0, 0) / {scale}.0)"


def case_bins(expr: str, edges: Sequence[float]) -> str:
    """Right-closed bin index, first bin closed on the left, else NULL."""
    parts = []
    for i in range(len(edges) - 1):
        hi = edges[i + 1]
        if hi == INF:
            parts.append(f"WHEN {expr} >= {edges[0]} THEN {i}")
        else:
            cond = f"{expr} >= {edges[0]} AND {expr} <= {hi}" if i == 0 else f"{expr} <= {hi}"
            if i > 0:
                cond = f"{expr} >= {edges[0]} AND " + cond
            parts.append(f"WHEN {cond} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def values_table(name: str, cols: Sequence[str], rows: Sequence[Sequence]) -> str:
    """``name(cols) AS (VALUES ...)`` CTE text."""
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) t({', '.join(cols)}))"


def label_table(name: str, labels: Sequence[str], idx: str = "bin_idx", label: str = "label") -> str:
    return values_table(name, [idx, label], [(i, s) for i, s in enumerate(labels)])


def int_axis(name: str, col: str, values: Sequence[int]) -> str:
    return f"{name} AS (SELECT CAST(x AS INTEGER) AS {col} FROM (VALUES {', '.join(f'({v})' for v in values)}) t(x))"


def flag(cond: str) -> str:
    """Predicate → 1.0 / 0.0 as DOUBLE, NULL counted as 0."""
    return f"(CASE WHEN {cond} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def share(n: str, total: str, digits: int) -> str:
    """``pround(n / total * 100, digits)`` with DOUBLE division."""
    return pr(f"CAST({n} AS DOUBLE) / CAST({total} AS DOUBLE) * 100.0", digits)
