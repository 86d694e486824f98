"""Ordered scans of groups of any size: rows lie in range partitions, and state is carried over their edges.

A window over a group reads the group in one task.  Here rows are dealt by ranges of (group, order), so a
group with most of the rows is many tasks' work: each range is scanned by itself, its total is one row,
and what the ranges before it add comes from those rows alone.  As ranges follow one another, at most one
group goes on from each range to the next, so what is carried is at most one row a range and is broadcast.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Rows carried up to which they are broadcast.
FEW = 100_000


def _sorted_by(name: str) -> Column:
    return F.desc(name[1:]) if name.startswith("-") else F.asc(name)


class Ordered:
    """Rows in the order of ``by`` and ``order`` (names; a leading minus is descending), kept once in the shared folder."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str]):
        keys = [*(F.asc(c) for c in by), *map(_sorted_by, order)]
        placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        self.by, self.columns = by, df.columns
        self.df = cut(placed.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))

    def _with(self, df: DataFrame) -> Ordered:
        other = object.__new__(Ordered)
        other.by, other.columns, other.df = self.by, self.columns, df
        return other

    def add(self, **columns: Column) -> Ordered:
        return self._with(self.df.withColumns(columns))

    def where(self, condition: Column | str) -> Ordered:
        return self._with(self.df.where(condition))

    def carry(self, ahead: bool = False, within: tuple[str, ...] = (), **wanted: tuple[str, Column]) -> Ordered:
        """Adds columns over the rows before each row of its group, or after it with ``ahead``: the ``sum``, ``max`` or
        ``min`` of a column there, or its value that is ``near``, the closest one that isn't null; null where there is none.

        With ``within`` only rows count that agree in these columns too, in the order that the rows have already; what is
        carried is then a row a range and value; it is kept, and broadcast up to ``FEW`` of them."""
        fold = {"sum": F.sum, "max": F.max, "min": F.min, "near": lambda c: F.last(c, ignorenulls=True)}
        join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least, "near": lambda a, b: F.coalesce(b, a)}
        toward = F.desc if ahead else F.asc
        rows = self.df.withColumns({f"_v_{n}": c for n, (_, c) in wanted.items()})
        by = [*self.by, *within]
        here = Window.partitionBy(*by, "_range").orderBy(toward("_at")).rowsBetween(Window.unboundedPreceding, -1)
        last = F.min_by if ahead else F.max_by
        total = {"sum": F.sum, "max": F.max, "min": F.min, "near": lambda c: last(c, F.when(c.isNotNull(), F.col("_at")))}
        totals = rows.groupBy(*by, "_range").agg(*(total[k](F.col(f"_v_{n}")).alias(f"_v_{n}") for n, (k, _) in wanted.items()))
        over = Window.partitionBy(*by).orderBy(toward("_range"))
        earlier = over.rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*(F.col(c).alias(f"_k_{i}") for i, c in enumerate(by)), F.col("_range").alias("_k_range"), F.row_number().over(over).alias("_n"), *(fold[k](F.col(f"_v_{n}")).over(earlier).alias(f"_c_{n}") for n, (k, _) in wanted.items()))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{i}")) for i, c in enumerate(by)], F.col("_range") == F.col("_k_range"))
        scanned = rows.withColumns({f"_h_{n}": fold[k](F.col(f"_v_{n}")).over(here) for n, (k, _) in wanted.items()})
        later = carried.where("_n > 1")
        if within:
            later = cut(later)
        both = scanned.join(F.broadcast(later) if not within or later.count() <= FEW else later, same, "left")
        return self._with(both.select(*self.df.columns, *(join[k](F.col(f"_c_{n}"), F.col(f"_h_{n}")).alias(n) for n, (k, _) in wanted.items())))

    def rows(self) -> DataFrame:
        return self.df.drop("_range", "_at")

    def threaded(self, fold) -> DataFrame:
        """Rows that ``fold(rows, state) -> (rows, state)`` keeps where each range begins with the state the one before left.

        ``state`` is a short text, empty at first; what it holds must be bounded.  Every range is folded from an empty
        state first; then those are folded again whose state turned out to be another, until none is.  The states,
        one a range, are all that the driver holds.
        """
        ranges = sorted(r[0] for r in self.df.select("_range").distinct().collect())
        begins = dict.fromkeys(ranges, "")
        after = dict(zip(ranges, ranges[1:], strict=False))
        todo, left = ranges, {}

        def of(chosen: list[int]) -> DataFrame:
            states = self.df.sparkSession.createDataFrame([(r, begins[r]) for r in chosen], "_range int, _state string")
            return self.df.where(F.col("_range").isin(chosen)).join(F.broadcast(states), "_range").groupBy("_range")

        def split(rows: pa.Table) -> tuple[pa.Table, str]:
            rows = rows.sort_by("_at")
            return rows.drop_columns(["_state"]), rows.column("_state")[0].as_py()

        def leave(rows: pa.Table) -> pa.Table:
            held, state = split(rows)
            return pa.table({"_range": pa.array(rows.column("_range")[:1].to_pylist(), pa.int32()), "state": pa.array([fold(held, state)[1]], pa.string())})

        while todo:
            left |= {r[0]: r[1] for r in of(todo).applyInArrow(leave, "_range int, state string").collect()}
            todo = [after[r] for r in todo if r in after and begins[after[r]] != left[r]]
            begins |= {r: left[q] for q, r in after.items() if r in set(todo)}
        names = self.columns

        def keep(rows: pa.Table) -> pa.Table:
            return fold(*split(rows))[0].select(names)

        schema = self.df.select(names).schema
        return of(ranges).applyInArrow(keep, schema) if ranges else self.df.select(names)
