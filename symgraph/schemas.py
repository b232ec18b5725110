"""Orders of the graph tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranks by which evidence, search results and definitions are ordered.
CONFIDENCES = ("exact", "resolved", "heuristic")
KIND_ORDER = ("function", "method", "class", "struct", "interface", "endpoint", "table", "constant", "module")
KIND_PRIORITY = ("function", "method", "class", "struct", "interface", "constant", "table", "endpoint", "module")
CALL_TYPES = ("calls", "references", "queries")
IMPACT_TYPES = (*CALL_TYPES, "imports", "inherits", "implements")


def rank_in(values: tuple[str, ...], column: str | Column) -> Column:
    """The place of a value in ``values``; of others, their number."""
    c = F.col(column) if isinstance(column, str) else column
    found = F.array_position(F.array(*[F.lit(v) for v in values]), c).cast("int")
    return F.when(found > 0, found - 1).otherwise(len(values))
