"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    The optimizer may copy a column's expression into every use, also into lambdas, where
    it would run again for each element.  A lambda's variable can't be copied.
    """
    return F.transform(F.array(value), body)[0]
