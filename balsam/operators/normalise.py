"""Key columns and key collisions of a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import POLICIES


def add_keys(df: DataFrame, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add one key column per entry of {output column: (source column, policy name)}."""
    return df.withColumns({out: POLICIES[p](src) for out, (src, p) in spec.items()})


def key_collisions(df: DataFrame, column: str, policy: str) -> DataFrame:
    """Spellings whose key is shared by another spelling.

    Rows are reduced to distinct spellings before anything is grouped by key."""
    spellings = df.groupBy(F.col(column).alias("spelling")).agg(F.count("*").alias("n_rows"))
    keyed = spellings.withColumn("key", POLICIES[policy]("spelling")).filter("key <> ''")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n_spellings")).filter("n_spellings > 1")
    return keyed.join(shared, "key").select("key", "spelling", "n_rows", "n_spellings")
