"""Sinks (O07 result_sink, O08 topic_json_sink).

Results are written under the session's shared folder (``spark.checkpoint.dir``),
in a sub-folder named by the application and the result.  A repeated write has
the same target and mode ``overwrite``, so it replaces a partial attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def _target(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/results/{spark.sparkContext.applicationId}/{name}"


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_and_read(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Persist a result between stages and read it back (lineage cut)."""
    path = write_parquet(df, _target(spark, name), partition_by)
    return spark.read.parquet(path)


def write_json_and_read(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write rows as JSON lines and return ``(json)`` strings read back."""
    path = _target(spark, name)
    df.write.mode("overwrite").json(path)
    return spark.read.text(path).withColumnRenamed("value", "json")


def save_model(model, spark: SparkSession, name: str) -> str:
    """Save a fitted MLlib model; a repeated save replaces it."""
    path = _target(spark, f"models/{name}")
    model.write().overwrite().save(path)
    return path
