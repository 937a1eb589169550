"""Running values over groups of any size: a scan in two phases over blocks of rows.

Rows are dealt by ranges of (group, order), sampled by Spark, so a block is a bounded run of rows, a large group spans
many blocks and sparse or skewed order values change nothing.  Each block is scanned on its own and leaves one summary
row per group it touches; the summaries of a group, at most one a block, are scanned next, and what comes before a block
is joined to its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settle import settle

BLOCK = "__block"


def _cols(names) -> list:
    return [names] if isinstance(names, (str, Column)) else list(names)


class Blocks:
    """Rows of a table in blocks; `running` adds columns that look back over all earlier rows of the group."""

    def __init__(self, df: DataFrame, group: Sequence[str], order: Sequence[str], parts: int | None = None):
        self.group, self.order = _cols(group), _cols(order)
        parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        # Written once: a range exchange dealt anew could cut elsewhere.
        self.rows = settle(df.repartitionByRange(parts, *self.group, *self.order).withColumn(BLOCK, F.spark_partition_id()))

    def _window(self):
        return Window.partitionBy(BLOCK, *self.group).orderBy(*self.order)

    def running(self, **scans: tuple[str, Column]) -> Blocks:
        """New columns name=(kind, value).

        kind "last": the last value that is not null, of this row or before; "max_before", "prev": the largest and the
        last value of the rows before (prev: null counts as a value); "sum": the sum up to this row."""
        here, before = self._window().rowsBetween(Window.unboundedPreceding, 0), self._window().rowsBetween(Window.unboundedPreceding, -1)
        at = F.struct(*self.order)
        local, summary, carried = {}, [], {}
        upto = Window.partitionBy(*self.group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        for name, (kind, value) in scans.items():
            if kind == "last":
                local[name] = F.last(value, ignorenulls=True).over(here)
                summary.append(F.max_by(value, F.when(value.isNotNull(), at)).alias(f"__{name}"))
                carried[name] = F.last(f"__{name}", ignorenulls=True).over(upto)
            elif kind == "max_before":
                local[name] = F.max(value).over(before)
                summary.append(F.max(value).alias(f"__{name}"))
                carried[name] = F.max(f"__{name}").over(upto)
            elif kind == "prev":
                local[name] = F.last(F.struct(value.alias("v"))).over(before)
                summary.append(F.max_by(F.struct(value.alias("v")), at).alias(f"__{name}"))
                carried[name] = F.last(f"__{name}").over(upto)
            elif kind == "sum":
                local[name] = F.sum(value).over(here)
                summary.append(F.sum(value).alias(f"__{name}"))
                carried[name] = F.sum(f"__{name}").over(upto)
            else:
                raise ValueError(f"unknown scan {kind}")
        summaries = self.rows.groupBy(BLOCK, *self.group).agg(*summary)
        came = summaries.select(BLOCK, *self.group, *[c.alias(f"__{n}") for n, c in carried.items()])
        rows = self.rows.withColumns(local)
        both = rows.alias("r").join(came.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (BLOCK, *self.group)], "left")
        merge = {"last": F.coalesce, "max_before": F.greatest, "prev": F.coalesce,
                 "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
        columns = [merge[scans[n][0]](F.col(f"r.{n}"), F.col(f"c.__{n}")).alias(n) for n in scans]
        columns = [c["v"].alias(n) if scans[n][0] == "prev" else c for c, n in zip(columns, scans, strict=True)]
        out = object.__new__(Blocks)
        out.group, out.order = self.group, self.order
        out.rows = both.select(*[F.col(f"r.{c}") for c in self.rows.columns if c not in scans], *columns)
        return out

    def result(self) -> DataFrame:
        return self.rows.drop(BLOCK)


def number_rows(df: DataFrame, order: str | Sequence[str], out: str, parts: int | None = None) -> DataFrame:
    """1-based position of every row in a total order.

    Rows are sorted inside their block and numbered as they are written; only the number of rows of each block is
    summed up, so no row is moved twice."""
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sort = _cols(order)
    # The id holds the block in its upper bits and the row's place in the block in the lower 33.
    rows = settle(df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("__id", F.monotonically_increasing_id()))
    block, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(block.alias(BLOCK)).agg(F.count("*").alias("__n"))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(BLOCK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    numbered = rows.withColumn(BLOCK, block).join(offsets, BLOCK)
    return numbered.withColumn(out, F.col("__offset") + place + 1).drop(BLOCK, "__offset", "__id")
