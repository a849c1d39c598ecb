"""Registration of a query with its equivalent SQL and its output columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateauscope.operators import quality as Q
from plateauscope.plans import relations as R
from plateauscope.plans.audit import Audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_AUDITS: dict[tuple, Audit] = {}

SPARK_TYPES = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
SQL_TYPES = {"s": "VARCHAR", "i": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in spec.split()]


def tidy(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        col = F.col(name).cast(SPARK_TYPES[kind])
        out.append((F.round(col, 6) + F.lit(0.0) if kind == "d" else col).alias(name))
    return df.select(*out)


def tidy_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        col = f'CAST("{name}" AS {SQL_TYPES[kind]})'
        out.append((f"round({col}, 6) + 0.0" if kind == "d" else col) + f' AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({body}) tidy"


def register(name: str, spec: str, sql: str | None = None, ctes: str = ""):
    """Decorator: ``fn(spark, sf_dir)`` under ``name``; ``sql`` may be omitted."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), spec)
        if sql is not None:
            SQL[name] = ctes + tidy_sql(sql, spec)
        return fn
    return wrap


def audit(spark: SparkSession, sf_dir: str) -> Audit:
    """The audit of the derived sweep, shared by the queries of one application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _AUDITS:
        passes = R.sweep(spark, sf_dir)
        policy = Q.policy_frame(passes, min_trades=R.min_trades(spark, sf_dir))
        _AUDITS[key] = Audit(passes, policy)
    return _AUDITS[key]


def forget() -> None:
    _AUDITS.clear()
