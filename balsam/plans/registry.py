"""Registration of queries: a Spark callable, its inputs, and (where SQL can say it) an oracle.

Inputs are the driver tables or views over them.  A view is one SELECT in the SQL that Spark
and DuckDB share, so both sides of a check read the same input; `{name}` marks a table or view."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@dataclass(frozen=True)
class View:
    spark: str
    duck: str


VIEWS: dict[str, View] = {}
QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_REF = re.compile(r"\{([a-z_]\w*)\}")


def view(name: str, sql: str, duck: str | None = None) -> None:
    """Declare a view; `duck` only where DuckDB needs other syntax."""
    VIEWS[name] = View(sql, duck or sql)


class Tables:
    """Attribute access to driver tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self._once(name, lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        if name in VIEWS:
            return self._once(name, lambda: self.sql(VIEWS[name].spark))
        raise AttributeError(name)

    def _once(self, name, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Run a SELECT whose `{name}` parts are tables or views."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(_REF.findall(text))})


def _duck(sql: str) -> str:
    """Plain DuckDB text: views become common table expressions, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _REF.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name].duck)
                order.append(name)

    visit(sql)
    ctes = [f"{n} AS ({_REF.sub(r'\1', VIEWS[n].duck)})" for n in order]
    body = _REF.sub(r"\1", sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its DuckDB equivalent."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _duck(sql)
        return fn

    return add
