"""The one error of definitions and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame


class GeometryError(ValueError):
    """A definition or a geometric rule contradicts itself."""


def require_empty(bad: DataFrame, message: str, show: int = 5) -> None:
    """Raises GeometryError with the first few rows of bad, if it has any."""
    rows = bad.limit(show).collect()
    if rows:
        raise GeometryError(f"{message}: " + "; ".join(str(tuple(r)) for r in rows))
