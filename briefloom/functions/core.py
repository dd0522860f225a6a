"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it many times in `body`.

    A plain expression would be copied to each use, and a filter is pushed below the projection which names it, so it
    would also be computed once per use. Bound this way a text is normalised once however many terms look at it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: Column, body: str) -> Column:
    """`let` with the body as SQL text (`x -> …`). Large bodies are parsed in one go instead of being put together
    call by call from the driver."""
    return F.get(F.call_function("transform", F.array(value), F.expr(body)), F.lit(0))


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_holds(name: str, terms: Sequence[str]) -> str:
    """SQL condition: the lower-case text `name` holds one of the terms."""
    return "(" + (" OR ".join(f"contains({name}, {sql_string(t.lower())})" for t in terms) or "false") + ")"
