"""Rendering of small results on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def rows_of(df: DataFrame, most: int = 10_000) -> list[dict]:
    """Rows of a report table; a table with more than `most` rows is no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [r.asDict() for r in rows]


def number(value, digits: int = 1) -> str:
    if value is None:
        return ""
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, digits: int = 1) -> str:
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(number(v, digits) for v in r.values()) + " |" for r in rows_of(df))])


def to_json(tables: dict[str, DataFrame]) -> str:
    return json.dumps({k: rows_of(v) for k, v in tables.items()}, indent=1, default=float)


def share(part: float, low: float | None = None, high: float | None = None) -> str:
    """A percentage with its interval, as 11.7% (10-15)."""
    text = f"{100 * part:.1f}%"
    return text if low is None or high is None else f"{text} ({100 * low:.0f}-{100 * high:.0f})"
