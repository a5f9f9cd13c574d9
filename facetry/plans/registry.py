"""Queries over the star-schema tables, by the inventory's ids, with their DuckDB SQL.

``query(name, sql)`` registers a function of (spark, sf_dir); modules beside this one hold them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["f0_site_free_energy"](spark, sf_dir)


from facetry.plans import sites, bonds, grids, tables, evaluation, paths  # noqa: E402, F401
