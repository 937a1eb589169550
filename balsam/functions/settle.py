"""Materialise a table that several later steps read.

The table is written as Parquet into the shared folder that the cluster names in
`spark.checkpoint.dir`: it survives lost executors, cuts the lineage, gives the optimiser a real
size, and later readers load only the columns they need."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is named and all runs in one process."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the session's shuffle partitions, for work that is costly per row.

    A compressed file of many rows is read by as many tasks as it has row groups, however many cores wait."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
