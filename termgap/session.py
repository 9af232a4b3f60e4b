"""Session helpers: input spreading and the shared staging area."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate: file bytes for a written table, a guess for a plan over one. Rows take more in memory."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _conf_bytes(spark: SparkSession, name: str) -> int:
    value = spark.conf.get(name)
    return -1 if value.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


def spread(df: DataFrame, *keys: str, task_bytes: int | None = None) -> DataFrame:
    """Hash-spread an input too small to give every core a scan split; leave large inputs where they are.

    A lone parquet file is read by one task however many cores wait. The planner's size estimate decides: once the
    input holds two splits per core, the scan itself is parallel enough and no shuffle is added.

    ``task_bytes`` spreads an input of any size over as many tasks as hold that much each: for steps whose memory grows
    with what a task reads.
    """
    spark = df.sparkSession
    slots = 2 * spark.sparkContext.defaultParallelism
    if task_bytes:
        return df.repartition(max(slots, -(-estimated_bytes(df) // task_bytes)), *keys)
    if estimated_bytes(df) >= slots * _conf_bytes(spark, "spark.sql.files.maxPartitionBytes"):
        return df
    return df.repartition(slots, *keys)


def lookup_side(df: DataFrame) -> DataFrame:
    """Mark the lookup side of a join against exploded rows.

    Exploded rows are far larger than the planner thinks, so left alone it may broadcast the wrong side. The lookup is
    broadcast while its own estimate is under the broadcast threshold. Beyond it both sides are shuffled and the lookup
    is hashed per partition; AQE splits skewed partitions of the other side.
    """
    limit = _conf_bytes(df.sparkSession, "spark.sql.autoBroadcastJoinThreshold")
    return F.broadcast(df) if estimated_bytes(df) <= limit else df.hint("shuffle_hash")


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="termgap-")


class Staging:
    """Written tables that several outputs share, or that cut the lineage of an iteration.

    A written table survives the loss of any executor and is read back column by column.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{staging_root(spark).rstrip('/')}/termgap-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the staged tables. Call once every output that reads them has been written."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(hadoop, True)

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, *_) -> None:
        self.close()
