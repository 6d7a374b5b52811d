"""Helpers for building expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once and written once, however often ``then`` uses it.

    ``then`` can't hold a Python function. If the result goes into one, no function
    inside ``then`` may name what ``then`` was given.
    """
    return F.element_at(F.transform(F.array(value), then), 1)
