"""The registered queries: text of the engine's dialect and the DuckDB text that must give the same rows.

Every query goes through the engine, with the tables of the folder attached as DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tarn.engine import Database
from tarn.session import table
from tarn.sources.store import scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str, text: str) -> Database:
    """A new database in which the text's tables can be read."""
    db = Database(spark, scratch(spark))
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            db.attach(t, table(spark, sf_dir, t))
    return db


def register(name: str, query: str, oracle: str | None = None, *, before: str = "", params: Sequence | Mapping | None = None) -> None:
    """before: statements that run first. oracle: DuckDB text; the query itself where both dialects agree."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, f"{before} {query}")
        if before:
            db.exec(before)
        return db.df(query, params)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or query


def register_steps(name: str, steps: Callable[[Database], DataFrame], tables: str, oracle: str) -> None:
    """A query made of calls of the engine's interface; tables names those it reads."""
    QUERIES[name] = lambda spark, sf_dir: steps(database(spark, sf_dir, tables))
    ORACLE_SQL[name] = oracle
