"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once a row, even where ``then`` uses it inside lambdas, which would repeat it for each element."""
    return F.transform(F.array(value), then)[0]
