"""Pandas and Arrow UDFs whose type is parsed at first use, so that modules load without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: the function, over pandas series, as a column function of the given SQL type."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(f, ddl)(*columns)

        return call

    return wrap


def columnar(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: the function, over Arrow arrays, as a column function of the given SQL type."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            return F.arrow_udf(f, ddl)(*columns)

        return call

    return wrap
