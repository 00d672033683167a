"""Cutting tables into ranges of ids without sorting them as a whole."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges for each shuffle partition: they are dealt out by hash, and several a task even out.
RANGES_A_PARTITION = 4
#: Keys that are looked at for each range; as many come to the driver, whatever the table.
KEYS_A_RANGE = 50


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_range(rows: DataFrame, key: str = "key") -> DataFrame:
    """rows with `part`: the number of the range of ids that each row's non-null key is in, ascending with it.

    Cuts come from a sample of the keys, for which only their column is read; they only choose how rows are dealt
    out. A row finds its range by binary search, and the plan doesn't grow with the ranges.
    """
    n = RANGES_A_PARTITION * partitions(rows)
    keys = rows.select(F.col(key).cast("double").alias("k"))
    share = min(1.0, KEYS_A_RANGE * n / max(1, keys.count()))
    found = sorted(keys.sample(share, seed=1).toPandas()["k"].tolist())
    cuts = sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []
    if not cuts:
        return rows.withColumn("part", F.lit(0))
    search = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__k", outputCol="__part")
    return search.transform(rows.withColumn("__k", F.col(key).cast("double"))).withColumn("part", F.col("__part").cast("int")).drop("__k", "__part")
