"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query builds its inputs from the given tables through the feed adapters,
so its work grows with them.  Parameters (reference day, periods, filters)
are the fixed test settings below.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.functions import periods as P
from tillroll.sources.fixtures import REF_DATE
from tillroll.workspace import Workspace

REF = P.as_date(REF_DATE)
CUR = P.resolve_period("Last 30 Days", REF)      # 1998-02-02 .. 1998-03-03
LY = P.ly_range(*CUR)                             # 1997-02-03 .. 1997-03-04
HEADLINE = ["revenue", "orders", "aov", "gross_margin_pct"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Workspace(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        QUERIES[name].of_workspace = fn
        return fn
    return deco


# modules register their queries on import
from tillroll.plans import registry  # noqa: E402,F401
from tillroll.plans import registry_reports  # noqa: E402,F401
