"""Ordered folds over small runs of rows, as array expressions.

A fold walks the rows of one run in order and either joins a row to what was put together before or
begins anew. Runs are cut beforehand where no join is possible whatever came before, so the arrays are
short and the work of a run, which is the square of its length at worst, stays small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(values: Column) -> Column:
    """Median of an array of numbers, null of an empty one."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def low(values: Column) -> Column:
    return F.array_min(values)


def high(values: Column) -> Column:
    return F.array_max(values)


def members(group: Column, field: str) -> Column:
    """One field of all rows of a group."""
    return F.transform(group, lambda r: r[field])


def grouped(rows: Column, kind: str, fits: Callable[[Column, Column], Column], latest_only: bool = True) -> Column:
    """Rows (an array of structs, in order) put into groups: an array of arrays of them.

    A row goes into the latest group that ``fits(group, row)``, or with ``latest_only`` into the last
    group if that fits, else into a new one. ``kind`` is the row's type.
    """

    def put(groups: Column, row: Column) -> Column:
        if latest_only:
            at = F.when((F.size(groups) > 0) & F.coalesce(fits(F.element_at(groups, -1), row), F.lit(False)), F.size(groups) - 1)
        else:
            at = F.array_max(F.transform(groups, lambda g, i: F.when(F.coalesce(fits(g, row), F.lit(False)), i)))
        grown = F.transform(groups, lambda g, i: F.when(i == at, F.concat(g, F.array(row))).otherwise(g))
        return F.when(at.isNotNull(), grown).otherwise(F.concat(groups, F.array(F.array(row))))

    return F.aggregate(rows, F.array().cast(f"array<array<{kind}>>"), put)
