"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settle(value: str | Column, digits: int) -> Column:
    """Round half up after removing the noise in the last bits of a double, so the result does
    not depend on the order in which a sum was added. Zero never carries a sign."""
    return F.round(F.round(value, 10), digits) + F.lit(0.0)
