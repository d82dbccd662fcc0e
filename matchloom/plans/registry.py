"""Named queries, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``uses`` names the shared CTEs its SQL reads."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, uses)
        return fn
    return add


def cte(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    CTES[name] = (uses, sql)


def with_ctes(sql: str, uses: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + sql.lstrip()


_BUILT: list[dict] = []


def shared(fn):
    """Build a stage once per session and folder.

    Some stages are written out and read back, so what is kept can be data of the
    moment it was made: call :func:`forget` after the tables of a folder change.
    """
    built: dict = {}
    _BUILT.append(built)

    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf)
        if key not in built:
            built[key] = fn(spark, sf)
        return built[key]

    return get


def forget() -> None:
    """Drop all shared stages, so that the next query starts from its tables."""
    for built in _BUILT:
        built.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
