"""Registry of demonstration queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULE: dict[str, str] = {}


def register(name: str, sql: str | None = None, rounded: Sequence[str] = (), digits: int = 6):
    """Register a query under ``name``.

    ``rounded`` lists the double columns rounded on both sides, because two engines may
    add floating-point numbers in different orders.
    """

    scale = 10.0**digits

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[
                (F.round(F.col(c).cast("double") * scale) / scale + F.lit(0.0)).alias(c) if c in rounded else F.col(c)
                for c in df.columns
            ])

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        MODULE[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            text = sql.strip().rstrip(";")
            if rounded:
                repl = ", ".join(f'round(CAST("{c}" AS DOUBLE) * 1e{digits}) / 1e{digits} + 0.0 AS "{c}"' for c in rounded)
                text = f"SELECT * REPLACE ({repl}) FROM ({text}) AS checked"
            ORACLES[name] = text
        return fn

    return wrap
