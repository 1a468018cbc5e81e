"""Metric algebra: base sums and derived formulas compiled to ``Column``s.

Derived metrics are evaluated over the *sums* of their base metrics (ratio of
sums, never sum of ratios).  Formula text from :mod:`tillroll.model` is parsed
once with :mod:`ast` on the driver; only ``+ - * /``, parentheses, numbers and
base-metric names are accepted.  ``/`` becomes ``try_divide`` so a zero
denominator yields null (never an error under ANSI mode, never infinity).
"""
from __future__ import annotations

import ast
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll import model as M

Resolver = Callable[[str], Column]


def _compile(node: ast.AST, resolve: Resolver) -> Column:
    if isinstance(node, ast.Expression):
        return _compile(node.body, resolve)
    if isinstance(node, ast.BinOp):
        a, b = _compile(node.left, resolve), _compile(node.right, resolve)
        if isinstance(node.op, ast.Add):
            return a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Div):
            return F.try_divide(a, b)
        raise ValueError(f"operator {type(node.op).__name__} not allowed in formulas")
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_compile(node.operand, resolve)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        if node.id not in M.BASE_METRICS:
            raise ValueError(f"unknown base metric {node.id!r} in formula")
        return resolve(node.id)
    raise ValueError(f"unsupported formula element {ast.dump(node)}")


def formula_inputs(name: str) -> list[str]:
    """Base metrics a metric needs (itself when it is a base metric)."""
    if name in M.BASE_METRICS:
        return [name]
    tree = ast.parse(M.DERIVED_METRICS[name][0], mode="eval")
    seen: list[str] = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and n.id not in seen:
            seen.append(n.id)
    return seen


def inputs_for(metrics: list[str]) -> list[str]:
    out: list[str] = []
    for m in metrics:
        for b in formula_inputs(m):
            if b not in out:
                out.append(b)
    return out


def metric_column(name: str, resolve: Resolver) -> Column:
    """Column computing metric ``name`` from base-sum columns given by ``resolve``."""
    if name in M.BASE_METRICS:
        return resolve(name)
    if name not in M.DERIVED_METRICS:
        raise KeyError(name)
    return _compile(ast.parse(M.DERIVED_METRICS[name][0], mode="eval"), resolve)


def base_sum(metric: str, cond: Column | None = None, col: str | None = None) -> Column:
    """SUM of a base metric as double; all-null/empty -> 0.  Optional row condition."""
    c = F.col(col or metric)
    if cond is not None:
        c = F.when(cond, c)
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def pct_change(cur: Column, cmp: Column) -> Column:
    """(cur / cmp - 1) * 100; null when either side is null or cmp = 0."""
    return (F.try_divide(cur, cmp) - F.lit(1.0)) * F.lit(100.0)


def is_good(metric, delta: Column) -> Column:
    """Favourability of a change: up is good, inverted for reverse-polarity metrics.

    A zero change counts as up, so for a reverse metric it is *not* good.
    ``metric`` is a name or a column of names."""
    name = F.lit(metric) if isinstance(metric, str) else metric
    reverse = [m for m in M.ALL_METRICS if M.metric_polarity(m) == "reverse"]
    return F.when(delta.isNotNull(), (delta >= 0) != name.isin(reverse))


def delta_in_units(metric, cur: Column, cmp: Column) -> Column:
    """Absolute change in the metric's own unit: percentage points for percents."""
    d = cur - cmp
    if isinstance(metric, str):
        return d * F.lit(100.0) if M.metric_format(metric) == "percent" else d
    percents = [m for m in M.ALL_METRICS if M.metric_format(m) == "percent"]
    return F.when(metric.isin(percents), d * F.lit(100.0)).otherwise(d)
