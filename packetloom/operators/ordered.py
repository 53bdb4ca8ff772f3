"""Running sums and ranks over a whole table without bringing it into one task.

A global window would put all rows into one partition. Here the table is cut into ranges by Spark's own range partitioning; each range is passed over once, in order, and gets
the sums of the ranges before it from a table with a row for each range.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from packetloom.session import written

#: Whole numbers are summed up, or their bits are.
SUMS = {"sum": (np.cumsum, np.subtract, np.add, F.sum, lambda a, b: a + b), "xor": (np.bitwise_xor.accumulate, np.bitwise_xor, np.bitwise_xor, F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def starts(columns: Sequence[pa.Array], before: tuple | None) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; `before` is the row before the first, None without one."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    new[0] = before is None or before != tuple(c[0].as_py() for c in columns)
    return new


def running_sums(df: DataFrame, order: Sequence[Column], values: Mapping[str, Column], by: Sequence[str] = (), how: str = "sum", ranges: int | None = None) -> DataFrame:
    """`df` with, for each name in `values`, the sum of that whole number (null counts as 0) over the rows up to and including each, in this order; within rows that agree in `by`, if given.

    Rows that agree in all of `order` come in any order, but each has its own sum; they, and rows of the same `by`, may lie in several ranges however many they are. There are as many
    ranges as the session has shuffle partitions if `ranges` isn't given. One shuffle; the ranges are written once to the shared folder. how: sum, or xor of the bits.
    """
    accumulate, without, plus, total, add = SUMS[how]
    names = list(values)
    own = [f"_value{k}" for k in range(len(names))]
    rows = df.withColumns({c: F.coalesce(values[n].cast("long"), F.lit(0)) for c, n in zip(own, names)} | {"_mixed": F.monotonically_increasing_id()})
    keys = [*(F.col(c).asc() for c in by), *order, F.col("_mixed").asc()]
    rows = rows.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys).drop("_mixed")
    fields = [f for f in rows.schema.fields if f.name not in own]
    kinds = StructType([*fields, *(StructField(n, LongType()) for n in names), StructField("_part", IntegerType()), StructField("_head", BooleanType()), StructField("_first", BooleanType()), StructField("_last", BooleanType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums within a range. `_head`: rows of the range's first group, where sums of earlier ranges may have to be added."""
        part, carry, before, head, waiting = TaskContext.get().partitionId(), [0] * len(names), None, True, None

        def closed(columns: list, last: bool) -> pa.RecordBatch:
            flag = np.zeros(len(columns[0]), bool)
            flag[-1] = last
            return pa.RecordBatch.from_arrays([*columns, pa.array(flag)], names=kinds.names)

        for b in batches:
            n = len(b)
            if not n:
                continue
            at = b.schema.get_field_index
            groups = [b.column(at(c)) for c in by]
            new = starts(groups, before) if by else np.zeros(n, bool)
            first = before is None
            if first:
                new[0] = True
            place = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # where a row's group begins, -1: before this batch
            columns = [b.column(at(f.name)) for f in fields]
            heads = np.full(n, head)
            if head:
                cut = np.flatnonzero(new[1:] if first else new)
                if len(cut):
                    heads[cut[0] + first :], head = False, False
            for k, c in enumerate(own):
                v = b.column(at(c)).to_numpy(zero_copy_only=False)
                run = accumulate(v)
                gone = np.where(place >= 0, np.concatenate(([0], run[:-1]))[place], 0)
                run = np.where(place >= 0, without(run, gone), plus(run, carry[k]))
                carry[k] = run[-1]
                columns.append(pa.array(run, pa.int64()))
            one = np.zeros(n, bool)
            one[0] = first
            before = tuple(c[n - 1].as_py() for c in groups)
            if waiting:
                yield closed(waiting, False)
            waiting = [*columns, pa.array(np.full(n, part, "i4")), pa.array(heads), pa.array(one)]
        if waiting:
            yield closed(waiting, True)

    rows = written(rows.mapInArrow(summed, kinds), "ranges")
    # a row or two for each range: what its last group has so far, and what its first group asks for
    ends = rows.filter("_last").select("_part", F.lit(True).alias("_gives"), *by, *names)
    asks = rows.filter("_first").select("_part", F.lit(False).alias("_gives"), *by, *(F.lit(0).cast("long").alias(n) for n in names))
    earlier = Window.partitionBy(*by).orderBy("_part", "_gives")
    sums = ends.union(asks).select("_part", "_gives", *(total(n).over(earlier).alias(f"_before{k}") for k, n in enumerate(names))).filter("not _gives").drop("_gives")
    out = rows.join(F.broadcast(sums), "_part")
    return out.select(*(f.name for f in fields), *(F.when(F.col("_head"), add(F.col(n), F.col(f"_before{k}"))).otherwise(F.col(n)).alias(n) for k, n in enumerate(names)))


def running_sum(df: DataFrame, order: str, value: Column, name: str, ties: Sequence[str] = (), descending: bool = False, range_rows: int | None = None) -> DataFrame:
    """`running_sums` of one value by `order`, then `ties`. Rows with a null order come first, or last if descending; `range_rows`: rows that a range takes, roughly."""
    way = F.desc if descending else F.asc
    ranges = max(1, -(-df.count() // range_rows)) if range_rows else None
    return running_sums(df, [way(c) for c in (order, *ties)], {name: value}, ranges=ranges)


def newest(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last n rows by `order`, oldest first."""
    return df.orderBy(*map(F.desc, order)).limit(n).orderBy(*order)


def numbered_newest(df: DataFrame, n: int, order: Sequence[str], name: str = "no") -> DataFrame:
    """`newest` with each row's number, from 1, among all rows of `df`, which is run once: each task writes its last n rows, and how many it had."""
    by = [(c, "descending") for c in order]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = None, 0
        for b in batches:
            count += len(b)
            table = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            held = table.take(pc.sort_indices(table, by, null_placement="at_end")[:n]) if len(table) > n else table
        if held is not None and count:
            held = held.append_column("_task", pa.array(np.full(len(held), TaskContext.get().partitionId(), "i4"))).append_column("_rows", pa.array(np.full(len(held), count)))
            yield from held.combine_chunks().to_batches()

    rows = written(df.mapInArrow(last, StructType([*df.schema.fields, StructField("_task", IntegerType()), StructField("_rows", LongType())])), "newest")
    total = rows.groupBy("_task").agg(F.max("_rows").alias("n")).agg(F.sum("n")).first()[0] or 0
    back = F.row_number().over(Window.orderBy(*map(F.desc, order)))  # over n rows only
    return rows.drop("_task", "_rows").orderBy(*map(F.desc, order)).limit(n).withColumn(name, (F.lit(total) - back + 1).cast("long")).orderBy(*order)
