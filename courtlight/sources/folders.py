"""Where jobs put files that other tasks and the driver read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir, or in the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; a cluster raises, as its machines share none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        set_ = context._jsc.sc().getCheckpointDir()
        if not set_.isEmpty():
            named = set_.get()
        elif context.master.startswith("local[") or context.master == "local":
            named = f"file://{tempfile.gettempdir()}"
        else:
            raise RuntimeError("spark.checkpoint.dir is not set: executors and driver share no folder")
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, and again only from there if executors are lost."""
    df.write.parquet(path := new_folder(df.sparkSession, what))
    return df.sparkSession.read.schema(df.schema).parquet(path)
