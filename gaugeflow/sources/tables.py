"""Stage tables, metric documents and fitted pipelines at rest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators.boosting import BoostedTrees
from gaugeflow.operators.mixture import Clusters
from gaugeflow.operators.neural import MlpModel
from gaugeflow.operators.random_trees import RandomForest

STAGES = ("cleaned", "features", "train", "val", "test")


def write_stage_tables(stages: Mapping[str, DataFrame], folder: str, ts_col: str | None = None) -> None:
    """One Parquet table per stage; with a time column, partitioned by month."""
    for name, df in stages.items():
        out = f"{folder}/{name}"
        if ts_col is None:
            df.write.mode("overwrite").parquet(out)
        else:
            # by time first, so that a task writes few months and a busy month has several tasks
            month = df.withColumn("month_key", F.date_format(ts_col, "yyyy-MM")).repartitionByRange(ts_col)
            month.write.mode("overwrite").partitionBy("month_key").parquet(out)


def read_stage_tables(spark: SparkSession, folder: str, names=STAGES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}").drop("month_key") for name in names}


def write_metrics(df: DataFrame, path: str) -> None:
    """JSON lines that keep missing values as explicit nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric rows; a literal NaN in the file is read as such."""
    return spark.read.schema(schema).option("allowNonNumericNumbers", "true").json(path)


def save_model(model, path: str) -> None:
    """Store a fitted model: MLlib pipelines in their own format, other models by their ``save`` with
    the name of their class beside it. What stood at ``path`` is replaced."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
        return
    spark = SparkSession.active()
    kind = [(type(model).__name__,)]
    spark.createDataFrame(kind, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/kind")
    model.save(spark, f"{path}/model")


def load_model(path: str):
    """The model that ``save_model`` stored, of whatever class."""
    spark = SparkSession.active()
    kind = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind")
    if not kind.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(kind):
        return PipelineModel.load(path)
    classes = {c.__name__: c for c in (RandomForest, BoostedTrees, Clusters, MlpModel)}
    return classes[spark.read.text(f"{path}/kind").first()[0]].load(spark, f"{path}/model")
