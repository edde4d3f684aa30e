"""Arrow-vectorised helpers whose return type is given as DDL and looked up at first use."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(ddl: str) -> Callable:
    """Makes a function of pandas Series into one of columns; ``plain`` is the function itself."""

    def wrap(f: Callable) -> Callable:
        made: list = []

        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            if not made:
                made.append(F.pandas_udf(f, ddl))
            return made[0](*columns)

        call.plain = f
        return call

    return wrap
