"""Registered queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import importlib
import pkgutil
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.plans.tables import SQL_TABLES, Tables
from galeframe.session import configure

DIGITS = 6
# Means of short decimals often end in an exact half of the last digit, which the last
# bit of a sum would decide; a shift far below that digit takes them off the edge.
SHIFT = 1.7e-8


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None
    num: tuple[str, ...]
    ts: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The result with doubles rounded and timestamps as text, so both engines agree."""
        df = self.plan(Tables(configure(spark), sf_dir))
        tidy = {c: F.round(F.col(c).cast("double") + SHIFT, DIGITS) + F.lit(0.0) for c in self.num}
        tidy |= {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in self.ts}
        return df.withColumns(tidy) if tidy else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        tidy = [f"round(CAST({c} AS DOUBLE) + {SHIFT}, {DIGITS}) + 0e0 AS {c}" for c in self.num]
        tidy += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in self.ts]
        replace = f" REPLACE ({', '.join(tidy)})" if tidy else ""
        ctes = ",\n".join(f"{n} AS ({SQL_TABLES[n].strip()})" for n in _needed(self.sql))
        head = f"WITH {ctes}\n" if ctes else ""
        return f"{head}SELECT *{replace} FROM (\n{self.sql.strip()}\n) AS result"


def _needed(sql: str) -> list[str]:
    """Input views a statement uses, in definition order."""
    used: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in SQL_TABLES.items():
            if name not in used and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                used.add(name)
                todo.append(body)
    return [n for n in SQL_TABLES if n in used]


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, num: str = "", ts: str = ""):
    """Register a plan; ``num`` and ``ts`` list its double and timestamp columns."""

    def keep(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, plan, sql, tuple(num.split()), tuple(ts.split()))
        return plan

    return keep


def load_all() -> dict[str, Query]:
    from galeframe import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"galeframe.plans.{module.name}")
    return REGISTRY
