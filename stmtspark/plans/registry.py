"""Queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtspark.plans import accounts_queries, layout_queries, records_queries, statements



def _plain(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with money as double and dates as ISO text, so that rows compare across engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        to = {"decimal": "double", "date": "string"}
        return out.select(*[F.col(n).cast(to[k.split("(")[0]]).alias(n) if k.split("(")[0] in to else F.col(n) for n, k in out.dtypes])

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _plain(q) for name, q in {**statements.QUERIES, **accounts_queries.QUERIES, **layout_queries.QUERIES, **records_queries.QUERIES}.items()}
ORACLES: dict[str, str] = {**statements.ORACLES, **accounts_queries.ORACLES, **layout_queries.ORACLES, **records_queries.ORACLES}
