"""Results that later steps read more than once, written to the shared folder: computed once, and plans stay small."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting a temporary one, if all runs on this machine (local master); on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
    return root.rstrip("/")


def writer(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a DataFrame as Parquet in the shared folder and reads it again."""
    root = shared_folder(spark)

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
