"""Named queries: a Spark plan over a data folder and, where SQL can say it, the SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def half_up(sql: str) -> str:
    """Let two-argument ``round`` go through decimals, so halves round up as they do in Spark."""
    out, i = "", 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            return out + sql[i:]
        depth, k, comma = 1, j + 6, -1
        while depth:
            c = sql[k]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = k
            k += 1
        inner = sql[j + 6 : k - 1] if comma < 0 else sql[j + 6 : comma]
        digits = "" if comma < 0 else sql[comma + 1 : k - 1].strip()
        out += sql[i:j]
        if digits:
            out += f"CAST(round(CAST({half_up(inner)} AS DECIMAL(38, 10)), {digits}) AS DOUBLE)"
        else:
            out += f"round({half_up(inner)})"
        i = k


def add(key: str, plan: Plan, check: str | None = None) -> None:
    if key in PLANS:
        raise ValueError(f"query {key} is registered twice")
    PLANS[key] = plan
    if check is not None:
        CHECKS[key] = half_up(check)
