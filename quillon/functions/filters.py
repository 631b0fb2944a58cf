"""Typed filters as Column conditions. Fields are names of columns, never expressions."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.records import Clause, Filter

_COMPARE: dict[str, Callable] = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}


def condition(clause: Clause, columns: Sequence[str]) -> Column:
    if clause.field not in columns:
        raise ValueError(f"unknown filter field: {clause.field}")
    column = F.col("`" + clause.field.replace("`", "``") + "`")
    if clause.op in _COMPARE:
        if isinstance(clause.value, tuple):
            raise ValueError(f"{clause.op} filters do not accept tuple values")
        return _COMPARE[clause.op](column, F.lit(clause.value))
    if not isinstance(clause.value, tuple) or not clause.value:
        raise ValueError(f"{clause.op} filters require a non-empty tuple value")
    inside = column.isin(*clause.value)
    return inside if clause.op == "in" else ~inside


def apply(frame: DataFrame, wanted: Filter | None) -> DataFrame:
    """The rows for which every clause holds; rows for which one is NULL go. No filter changes nothing."""
    if wanted is None or wanted.is_noop():
        return frame
    return frame.where(reduce(operator.and_, (condition(c, frame.columns) for c in wanted.clauses)))


def refuse(wanted: Filter | None) -> None:
    """For retrievers that take no filters unless asked to."""
    if wanted is not None and not wanted.is_noop():
        raise NotImplementedError("Structured filters are not supported by this retriever.")
