"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def working_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, or what is set on the context; below this machine's temporary one only where neither is and Spark runs in this process."""
    root = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        root = given.get() if given.isDefined() else f"file://{tempfile.gettempdir()}/tetraspark"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back."""
    folder = working_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
