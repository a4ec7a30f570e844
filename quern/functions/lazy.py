"""pandas functions as column functions, made when they are called: workers can import the modules that hold them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_function(kind: str) -> Callable:
    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
