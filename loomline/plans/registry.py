"""Registration of named queries with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.functions.text import WS
from loomline.runtime import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return f"{work_dir(self.spark)}/{name}-{uuid.uuid4().hex}"


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its name; ``sql`` is the same query for DuckDB."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_yes_no(x: str) -> str:
    return f"CASE WHEN lower({sql_strip(x)}) IN ('yes', 'no') THEN lower({sql_strip(x)}) END"


def sql_collapse(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")
