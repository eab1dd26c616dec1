"""SQL fragments that several oracles share."""

from __future__ import annotations

from ..functions.seeded import sql_discrete_laplace, sql_key, sql_uniform

__all__ = ["ORDER_SUMMARY", "bin_of", "sql_discrete_laplace", "sql_key", "sql_uniform"]

#: The derived table, as a common table expression.
ORDER_SUMMARY = """os AS (SELECT l_orderkey AS rid, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS sum_qty,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS sum_price FROM lineitem GROUP BY l_orderkey)"""


def bin_of(x: str, lower: float, upper: float, bins: int) -> str:
    return f"CAST(least({bins - 1}, greatest(0, floor(({x} - {float(lower)!r}) / ({float(upper)!r} - {float(lower)!r}) * {bins}))) AS INTEGER)"
