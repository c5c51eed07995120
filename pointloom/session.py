"""Session defaults, table access and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "pointloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings the session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing the session must be a local one; a temporary folder of this machine is
    then used and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="pointloom-")
    spark.sparkContext.setCheckpointDir("file://" + made)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and the rows
    survive the loss of executors. Compressed columns take less disk than ``checkpoint()``."""
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def spread(table: DataFrame) -> DataFrame:
    """A scanned table in at least as many partitions as the cluster has cores, ahead of work in Python that weighs more than
    its rows. Only a table of fewer parts is moved (round robin, so no key matters); larger ones stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def release(*tables: DataFrame | None) -> None:
    """Removes tables written by ``materialize`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
