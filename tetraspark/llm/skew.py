"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it holds more than 1 / SHARE of the rows, and more than LEAST; so fewer than SHARE keys are.
SHARE, LEAST = 1000, 1000


Hot = list[tuple[object, int]]


def hot_of(counts: DataFrame, key: str, n: str = "n") -> Hot:
    """(key, salts) of each hot key, from a written table of rows a key: at that many salts no part of it is hot.

    Fewer than SHARE come to the driver.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    found = counts.filter((F.col(n) * SHARE > total) & (F.col(n) > LEAST) & F.col(key).isNotNull()).select(key, n).collect()
    return [(r[0], -(-r[1] * SHARE // total)) for r in found]


def hot_keys(rows: DataFrame, key: str) -> Hot:
    """hot_of() rows that aren't counted yet, which are read once for it."""
    n = rows.count()
    counts = rows.groupBy(key).agg(F.count("*").alias("__n")).filter((F.col("__n") * SHARE > n) & (F.col("__n") > LEAST) & F.col(key).isNotNull())
    return [(r[0], -(-r[1] * SHARE // n)) for r in counts.collect()]


def spread_join(rows: DataFrame, other: DataFrame, key: str, spread: str, how: str = "inner", hot: Hot | None = None) -> DataFrame:
    """rows.join(other, key, how), how being inner or left, for `other` with few rows a key.

    Rows of a hot key are dealt by their column `spread` to as many tasks as it has salts, and other's rows of it
    copied to each: at most 2 * SHARE copies a row of `other` in all. Without `hot` rows is counted first, so it
    should be a written table.
    """
    found = hot_keys(rows, key) if hot is None else hot
    if not found:
        return rows.join(other, key, how)
    kind = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("__salts", T.IntegerType())])
    few = F.broadcast(rows.sparkSession.createDataFrame(found, kind))  # fewer than SHARE rows
    dealt = rows.join(few, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    copies = other.join(few, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0))))).drop("__salts")
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")
