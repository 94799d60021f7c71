"""Session settings and the shared folder used for tables and checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "gaugeflow", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; the master comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A session on one machine (master ``local``) without the setting gets a folder of its own; a
    cluster without it is an error, as its executors share no local folder.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    made = tempfile.mkdtemp(prefix="gaugeflow-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_root(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{shared_dir(spark)}/gaugeflow/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused by a later call."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results not yet written out need them."""
    jvm, root = spark.sparkContext._jvm, scratch_root(spark)
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: survives the loss of any executor, and later passes
    read only the columns they need."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_shuffle(df: DataFrame) -> bool:
    """Whether computing ``df`` shuffles, so that reading it twice is costly."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.search(r"(?m)^[\s:+|*()0-9-]*Exchange ", plan) is not None
