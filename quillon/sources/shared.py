"""Tables that a plan writes aside and reads back, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; else ``/tmp/checkpoints`` for a single process. On a cluster no local folder would do, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/quillon-index"


def keeper(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """``keep(df, name)``, which writes a table to a folder of this call's own and reads it back, so that an iteration's lineage stays short."""
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
