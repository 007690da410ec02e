"""Registered queries: a Spark callable and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.fixtures import FIXTURES, TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to one folder of parquet tables and to inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        raise AttributeError(name)

    def sql(self, statement: str) -> DataFrame:
        """Run SQL whose `{name}` parts are tables or derived inputs."""
        used = {n: getattr(self, n) for n in (*TABLES, *FIXTURES) if "{" + n + "}" in statement}
        return self.spark.sql(statement, **used)


def _with_fixtures(sql: str) -> str:
    """Expand `{name}` parts into common table expressions DuckDB can run."""
    ctes: dict[str, str] = {}

    def expand(text: str) -> str:
        for n in FIXTURES:
            if "{" + n + "}" in text:
                if n not in ctes:
                    body = expand(FIXTURES[n])
                    ctes[n] = body
                text = text.replace("{" + n + "}", n)
        for n in TABLES:
            text = text.replace("{" + n + "}", n)
        return text

    body = expand(sql).strip()
    if not ctes:
        return body
    head = ", ".join(f"{n} AS ({q})" for n, q in ctes.items())
    if body[:5].upper() == "WITH ":
        rest = body[5:].lstrip()
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {head}, {rest[10:]}"
        return f"WITH {head}, {rest}"
    return f"WITH {head} {body}"


def query(name: str, sql: str | None = None):
    """Register `fn(t: Tables) -> DataFrame` under `name`."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = _with_fixtures(sql)
        return fn

    return register


def sql_query(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """Register a statement both engines can run (or a pair where spelling differs)."""
    query(name, duck_sql if duck_sql is not None else spark_sql)(lambda t: t.sql(spark_sql))


def check_names(names: Sequence[str]) -> None:
    """Fail when a registered key is missing."""
    missing = [n for n in names if n not in QUERIES]
    if missing:
        raise KeyError(missing)
