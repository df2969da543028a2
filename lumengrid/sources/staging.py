"""Tables that are written once in the folder that driver and executors share, so that plans stay short and lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lumengrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/lumengrid/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
