"""Shared helpers of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with value computed once for a row, however often f uses it or repeats it within lambdas."""
    return F.transform(F.array(value), f)[0]
