"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


#: Scratches that `opened` collects.
_opened: list[list[Scratch]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set on the context; only where neither is and Spark runs in this process (tests), one of this machine."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not named:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        named = given.get() if given.isDefined() else f"file://{tempfile.gettempdir()}/tetraspark-scratch"
    return named


class Scratch:
    """Writes DataFrames as Parquet below one fresh folder, and reads them back.

    A written table survives the loss of any executor. drop() removes a table that no later plan reads, remove()
    the whole folder, once what was made from it is written elsewhere or not needed any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        for found in _opened:
            found.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def remove(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def opened() -> Iterator[list[Scratch]]:
    """The scratches that are made within."""
    found: list[Scratch] = []
    _opened.append(found)
    try:
        yield found
    finally:
        _opened[:] = [x for x in _opened if x is not found]
