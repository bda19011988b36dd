"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "datavitals", master: str | None = None, **conf) -> SparkSession:
    """Build a session. Only settings that change results or plans are pinned here;
    sizing (executors, memory, shuffle partitions) belongs to the cluster's submit command."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Where it is unset, a folder set for the context by setCheckpointDir serves; failing that, one is made,
    but only for a master of `local` or `local[...]`, where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="datavitals-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of re-running the shuffle) and,
    unlike an RDD checkpoint, later passes read only the columns they use. Columns are stored
    by position so that names differing only in case or blanks survive."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/datavitals/{label}-{uuid.uuid4().hex}"
    stored = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*stored).write.parquet(path)
    return spark.read.schema(df.toDF(*stored).schema).parquet(path).toDF(*df.columns)
