"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/graphloom-shared"
    return f"{base.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: loops keep a short plan, and losing an executor costs no earlier round."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
