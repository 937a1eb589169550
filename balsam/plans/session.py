"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
PARTITIONS, ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Under these names a session keeps what the cluster had set.
BEFORE = {STATIC: "balsam.cluster.static", MEASURED: "balsam.cluster.measured",
          PARTITIONS: "balsam.cluster.partitions", ADVISORY: "balsam.cluster.advisory", BATCH: "balsam.cluster.batch"}
# A size that is only estimated counts compressed files and no rows that explode makes.
ESTIMATED_LIMIT = "1MB"
# Bytes of input files for each shuffle partition that a stage starts with, and compressed bytes that are joined to one task:
# sorts of a chain of joins hold a hundred times as much.
INPUT_BYTES, TASK_BYTES = 1 << 20, 8 << 20
# Rows that a Python worker holds at once: a document's keys and spans take some hundred times their bytes as Python objects.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Fix the time zone to UTC, as the timestamp rules need; all else stays as the cluster has it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name, kept in BEFORE.items():
        value = spark.conf.get(kept, None)
        if value is not None:
            spark.conf.set(name, value) if value else spark.conf.unset(name)
            spark.conf.unset(kept)
    return spark


def _input_bytes(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sum(files.getContentSummary(entry.getPath()).getLength() for entry in files.listStatus(path))


def prepare_tables(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """`prepare`, and broadcast what is estimated only if it is tiny; what a shuffle measured, as the cluster has it.

    Shuffles start with partitions in proportion to the files of `folder`, and tasks take no more than TASK_BYTES of them
    where they can be told apart, so a task's memory does not grow with the tables. Python workers get BATCH_ROWS at once."""
    prepare(spark)
    batch = int(spark.conf.get(BATCH))
    if not 0 < batch <= BATCH_ROWS:
        spark.conf.set(BEFORE[BATCH], str(batch))
        spark.conf.set(BATCH, str(BATCH_ROWS))
    static, measured = spark.conf.get(STATIC), spark.conf.get(MEASURED, None)
    if not static.startswith("-"):
        spark.conf.set(BEFORE[STATIC], static)
        spark.conf.set(BEFORE[MEASURED], measured or "")
        spark.conf.set(STATIC, ESTIMATED_LIMIT)
        spark.conf.set(MEASURED, measured or static)
    if folder is not None:
        partitions, advisory = spark.conf.get(PARTITIONS, None), spark.conf.get(ADVISORY, None)
        spark.conf.set(BEFORE[PARTITIONS], partitions or "")
        spark.conf.set(BEFORE[ADVISORY], advisory or "")
        least = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(PARTITIONS, str(max(least, _input_bytes(spark, folder) // INPUT_BYTES)))
        limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(advisory) if advisory else TASK_BYTES
        spark.conf.set(ADVISORY, str(min(limit, TASK_BYTES)))
    return spark
