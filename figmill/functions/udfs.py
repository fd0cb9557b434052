"""Pandas functions as column functions, made when first called, as their type can't be read before there is a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(kind: str) -> Callable:
    """The decorated function of Series becomes one of columns with results of type ``kind``; batches go through Arrow."""

    def add(f: Callable) -> Callable:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return add
