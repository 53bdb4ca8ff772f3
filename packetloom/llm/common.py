"""What the operators of this subpackage share: tables written to cut lineage, fields."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import scratch, written

__all__ = ["documents", "loaded", "scratch", "slices", "small_batches", "whole_text", "written"]
#: Rows of an Arrow batch that become Python objects at once.
SLICE_ROWS = 2_500


#: The one table of an operator that a worker keeps from task to task, by what it was made of.
_LOADED: dict[Any, Any] = {}


def loaded(key: Any, make: Callable[[], Any]) -> Any:
    """What `make` gives, once for each worker as long as the key stays the same. Workers live longer than a stage: another operator's table takes its place, and doesn't stay beside it."""
    if key not in _LOADED:
        _LOADED.clear()
        tidy()
        _LOADED[key] = make()
    return _LOADED[key]


def tidy() -> None:
    """Gives memory that a worker's earlier tasks have freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that a worker holds few rows as Python objects."""
    tidy()
    for b in batches:
        for k in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(k, SLICE_ROWS)


def small_batches(spark: SparkSession) -> None:
    """Lets the session exchange no more rows at once with Python workers than these take."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(int(spark.conf.get(name)), SLICE_ROWS)))


def whole_text(df: DataFrame, text: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
