"""Joins with a table of one row for each key, where some keys may have a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.session import written

#: A key is hot with more than one row of so many; so there are fewer hot keys than this, however large the table, and their rows of the other table can be broadcast.
HOT_SHARE = 1000
#: Keys with fewer rows are never hot.
HOT_ROWS = 20_000


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", where: Column | None = None) -> DataFrame:
    """`rows` joined with `table` (inner or left), which has one row, or a bounded number of rows, for each of `keys`; neither holds nulls there. where: what else rows that meet have to fulfil.

    Rows of hot keys meet their row of `table` by a broadcast of fewer than HOT_SHARE rows and aren't shuffled; all others are joined as Spark sees fit. Both tables are read more than once.
    """
    keys, n = list(keys), rows.count()
    if n <= HOT_ROWS:
        return _joined(rows, table, keys, how, where)
    least = max(HOT_ROWS, n // HOT_SHARE)
    hot = written(rows.groupBy(*keys).count().filter(F.col("count") > least).select(*keys), "hot")
    if hot.isEmpty():
        return _joined(rows, table, keys, how, where)
    few = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    of_hot = _joined(rows.join(F.broadcast(hot), keys, "left_semi"), few, keys, how, where)
    return of_hot.unionByName(_joined(rows.join(F.broadcast(hot), keys, "left_anti"), table, keys, how, where))


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], how: str, where: Column | None) -> DataFrame:
    if where is None:
        return rows.join(table, keys, how)
    other = [f"_of{n}" for n in keys]
    fits = reduce(lambda a, b: a & b, [F.col(n) == F.col(o) for n, o in zip(keys, other)], where)
    return rows.join(table.withColumnsRenamed(dict(zip(keys, other))), fits, how).drop(*other)
