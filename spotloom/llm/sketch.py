"""Percentiles with bounded relative error from signed logarithmic buckets.

A value falls into the bucket ``ceil(log_gamma(|value|))`` of its sign, ``gamma = (1 + error) / (1 - error)``; values too
small to tell from zero share one bucket. Counts of the same bucket add up, whatever partition, day or table they come
from, and a percentile is read off the running sum. Everything is a built-in expression; the shuffle carries one row per
group, bucket and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of a percentile's value, and the size below which a value counts as zero.
ERROR = 0.0005
TINY = 1e-9
#: Number of the outermost buckets, those of the infinities.
OUTERMOST = 2**31 - 1


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> tuple[Column, Column]:
    """(sign -1, 0 or 1, bucket number) of a value; ordered by value as (sign, sign * number)."""
    size = F.abs(value)
    sign = F.when(size < TINY, 0).when(value > 0, 1).otherwise(-1)
    return sign, F.when(size < TINY, 0).when(size == float("inf"), OUTERMOST).otherwise(F.ceil(F.log(size) / math.log(_gamma(error)))).cast("int")


def build_sketch(rows: DataFrame, groups: list[str], value: str, error: float = ERROR, infinite: bool = False) -> DataFrame:
    """(groups, sign, bucket, n): counts over all finite non-null values of each group.

    Null and NaN are not counted, infinities only if ``infinite`` is set, each sign in an outermost bucket of its own. Null group keys are a group of their own. Rows are combined before
    the shuffle, so a group with most of all rows is no burden: it has at most its number of buckets per task.
    """
    v = F.col(value).cast("double")
    sign, no = bucket(v, error)
    kept = rows.where(v.isNotNull() & ~F.isnan(v) & (F.lit(infinite) | (F.abs(v) < float("inf"))))
    return kept.groupBy(*groups, sign.alias("sign"), no.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of finer groups, other partitions or other days, added up to ``groups``. Same error in all of them."""
    return sketch.groupBy(*groups, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketch: DataFrame, groups: list[str], shares: list[float], error: float = ERROR) -> DataFrame:
    """(groups, share, value, n): for each share the smallest bucket at or below which that share of the values lies.

    ``value`` is the bucket's middle, within ``error`` of the exact percentile (the smallest value that at least that
    share of the values do not exceed), relative to it. A group's buckets number a few ten thousand at most, set by the
    range of its values and not by its rows.
    """
    order = [F.col("sign"), F.col("sign") * F.col("bucket")]
    w = Window.partitionBy(*groups).orderBy(*order)
    upto = sketch.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*groups)))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(q) - 1e-9))
    hit = [F.when((F.col("upto") >= rank(q)) & (F.col("upto") - F.col("n") < rank(q)), F.lit(q)) for q in shares]
    g = _gamma(error)
    middle = F.col("sign") * F.lit(2.0 / (g + 1)) * F.pow(F.lit(g), F.col("bucket"))
    found = upto.select(*groups, "total", middle.alias("value"), F.explode(F.array(*hit)).alias("share")).where("share is not null")
    return found.select(*groups, "share", "value", F.col("total").alias("n"))
