"""A query: its function, its columns with kinds, and SQL for the same rows.

Kinds are l (bigint), d (double, rounded to six places), s (string), b (boolean). Both sides are cast to them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.plans import fixtures

PLACES = 6
SQL_CAST = {"l": "cast({0} as bigint)", "d": f"round(cast({{0}} as double), {PLACES})", "s": "cast({0} as varchar)", "b": "cast({0} as boolean)"}


def cast(name: str, kind: str) -> Column:
    c = F.col(name)
    plain = {"l": c.cast("long"), "d": F.round(c.cast("double"), PLACES), "s": c.cast("string"), "b": c.cast("boolean")}
    return plain[kind].alias(name)


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    make: Callable[[SparkSession, str], DataFrame]
    body: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.make(spark, sf_dir).select(*(cast(c, k) for c, k in self.columns))

    @property
    def sql(self) -> str | None:
        if self.body is None:
            return None
        shown = ", ".join(f'{SQL_CAST[k].format(c)} as {c}' for c, k in self.columns)
        return f"with {self.body.strip()} select {shown} from result"


def query(found: list[Query], name: str, columns: str, body: str | None) -> Callable:
    """Registers a function as a query. columns: `kind:name name ...` groups; body: common table expressions, the last of them `result`."""
    pairs: list[tuple[str, str]] = []
    kind = "l"
    for word in columns.split():
        if ":" in word:
            kind, word = word.split(":")
        pairs.append((word, kind))

    def add(make: Callable) -> Callable:
        found.append(Query(name, tuple(pairs), make, body))
        return make

    return add


#: The packets of `fixtures.packets` in SQL.
P = "p as (select epoch_us(ts) as ts_us, " + ", ".join(f"{x} as {c}" for c, x in fixtures.PACKETS.items()) + " from events)"


def of_events(x: str, name: str) -> str:
    return f"m as (select event_id, {x} as {name} from events)"


def of_pages(x: str, name: str) -> str:
    return f"m as (select page_id, {x} as {name} from pages)"


def u(at: int | str, n: int, h: str = "h") -> str:
    """n bytes at `at` of hex digits as a number; null beyond the end."""
    return f"try_cast('0x' || case when length({h}) >= 2 * (({at}) + {n}) then substr({h}, cast(2 * ({at}) + 1 as bigint), {2 * n}) end as bigint)"
