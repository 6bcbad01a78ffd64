"""Registered queries: a Spark callable over a table folder, and the SQL that checks it."""

import re

from pyspark.sql import functions as F

from boutline.plans.testviews import VIEW_SQL, Tables

QUERIES = {}
ORACLES = {}


def near(col):
    """Six decimals, nudged off exact ties so that both engines round alike."""
    return F.round(col + 1e-9, 6)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame``. The oracle may name the v_* views; their CTEs are put in front."""

    def add(fn):
        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add


def _needed(sql: str, found: list[str] | None = None) -> list[str]:
    """Views the text uses, those a view builds on first."""
    found = [] if found is None else found
    for v in VIEW_SQL:
        if v not in found and re.search(rf"\b{v}\b", sql):
            _needed(VIEW_SQL[v], found)
            found.append(v)
    return found


def with_views(sql: str) -> str:
    sql = sql.strip()
    ctes = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in _needed(sql)]
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if not ctes:
        return sql
    head = "WITH RECURSIVE " + ",\n".join(ctes)
    return head + (",\n" + sql[own.end():] if own else "\n" + sql)
