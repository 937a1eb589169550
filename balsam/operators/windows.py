"""Ordered-group helpers shared by the other operators.

`keep_first` and `top_k` filter on a rank, which Spark turns into a partial group limit before
the shuffle: a mapper sends at most k rows of a key, however many it holds, so one key that owns
a large part of the table does not load one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Blocks, number_rows


def _cols(names) -> list:
    return [names] if isinstance(names, (str, Column)) else list(names)


def top_k(df: DataFrame, keys, order, k: int, rank_col: str | None = None) -> DataFrame:
    """First k rows of every key in the given total order."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    name = rank_col or "__rank"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in the given total order."""
    return top_k(df, keys, order, 1)


def duplicates(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*_cols(keys)).agg(F.count("*").alias("n")).filter("n > 1")


def forward_fill(df: DataFrame, group, order, columns: Sequence[str]) -> DataFrame:
    """Nulls take the last non-null value above them inside the group, however many rows it has."""
    scanned = Blocks(df, _cols(group), _cols(order)).running(**{c: ("last", F.col(c)) for c in columns})
    return scanned.result().select(*df.columns)


def next_boundary(df: DataFrame, group, start: str, default: Column, out: str) -> DataFrame:
    """Start of the next span of the group, else the default (the end of the text)."""
    w = Window.partitionBy(*_cols(group)).orderBy(start)
    return df.withColumn(out, F.coalesce(F.lead(start).over(w), default))


def running_groups(df: DataFrame, group, order, opens: Column, out: str) -> DataFrame:
    """Running count of rows that open a group: a group id per row."""
    w = (
        Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(out, F.sum(F.when(opens, 1).otherwise(0)).over(w))


def restart_groups(df: DataFrame, group, order, number: str, label: str, out: str) -> DataFrame:
    """A number not above the running maximum, under a new label, starts the next group."""
    blocks = Blocks(df, _cols(group), _cols(order)).running(
        __top=("max_before", F.col(number)), __label=("prev", F.col(label)))
    restarts = (F.col(number) <= F.col("__top")) & ~F.col(label).eqNullSafe(F.col("__label"))
    flag = F.when(F.coalesce(restarts, F.lit(False)), 1).otherwise(0)
    return blocks.running(**{out: ("sum", flag)}).result().select(*df.columns, out)


def contiguous(df: DataFrame, group, order, number: str) -> DataFrame:
    """Per group: do the numbers read 1..N in the given order?"""
    w = Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
    return (
        df.withColumn("__pos", F.row_number().over(w))
        .groupBy(*_cols(group))
        .agg(
            F.count("*").alias("n_rows"),
            F.bool_and(F.col(number).eqNullSafe(F.col("__pos"))).alias("is_contiguous"),
        )
    )


def monotonic(df: DataFrame, group, order, number: str) -> DataFrame:
    """Per group: is the number never below its predecessor?"""
    keys = _cols(group)
    rows = Blocks(df, keys, _cols(order)).running(__prev=("prev", F.col(number))).result()
    rises = F.coalesce(F.col(number) >= F.col("__prev"), F.lit(True))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.bool_and(rises).alias("is_monotonic"))


def global_number(df: DataFrame, order: str, out: str, bucket_rows: int | None = None) -> DataFrame:
    """1-based position of every row by a unique column, without a one-task sort.

    Ranges come from a sample of the values, so sparse values make no more blocks than dense ones;
    `bucket_rows`, once the width of a range of values, is not used any more."""
    return number_rows(df, order, out)


# --- array set semantics -------------------------------------------------------------------

def multiset_equal(a: Column | str, b: Column | str) -> Column:
    """Same values with the same multiplicities, in any order."""
    return F.sort_array(a).eqNullSafe(F.sort_array(b))


def set_equal(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_distinct(a)).eqNullSafe(F.sort_array(F.array_distinct(b)))


def is_subset(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(a, b)) == 0


def ordered_union(a: Column | str, b: Column | str) -> Column:
    """Values of a, then new values of b; blanks and nulls dropped, order kept."""
    def safe(c):
        return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))

    return F.filter(F.array_distinct(F.concat(safe(a), safe(b))), lambda x: x != "")


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do two tables hold the same rows with the same multiplicities?

    Each side is counted per distinct row first, so equal rows meet as one row each."""
    def counted(df, name):
        return df.groupBy(*df.columns).agg(F.count("*").alias(name))

    left, right = counted(a, "n_left"), counted(b.select(*a.columns), "n_right")
    on = [left[c].eqNullSafe(right[c]) for c in a.columns]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    diff = left.join(right, cond, "full_outer").filter(~F.col("n_left").eqNullSafe(F.col("n_right")))
    return diff.agg(
        F.count("*").alias("n_differences"), (F.count("*") == 0).alias("is_equal")
    )
