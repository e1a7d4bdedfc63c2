"""Named queries over the given tables, each with its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.plans.oracle import sql as complete

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    covers: str
    check: str | None


QUERIES: dict[str, Entry] = {}


def query(covers: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``covers`` lists the inventory rows it exercises."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = Entry(function, covers, complete(check) if check else None)
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, integers as bigint, for comparison across engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        column = F.col(f.name)
        if kind in ("double", "float"):
            # adding zero turns -0.0 into 0.0
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("long")
        out.append(column.alias(f.name))
    return df.select(*out)


def r6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 AS {name or expression}"
