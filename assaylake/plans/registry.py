"""The registered queries and their oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType, IntegerType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, decimals: str = "") -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows where there is such SQL.

    :param decimals: the columns, parted by blanks, that are decimals; both sides return them as doubles. Ints are
        returned as longs.
    """

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(f)
        def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            wide = {x.name: "double" for x in out.schema if isinstance(x.dataType, DecimalType)} | {x.name: "long" for x in out.schema if isinstance(x.dataType, IntegerType)}
            return out.withColumns({c: out[c].cast(kind) for c, kind in wide.items()})

        QUERIES[name] = plain
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in decimals.split())
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return f

    return add
