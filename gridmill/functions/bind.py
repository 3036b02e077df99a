"""Values that an expression works out once and reads many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, wherever and however often the body reads it.

    A column stands for its expression, so inside a lambda each mention would be worked out anew for each element.
    """
    return F.transform(F.array(value), body)[0]
