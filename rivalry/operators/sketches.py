"""Profiles of columns that can be kept per partition and merged: quantile and distinct sketches beside exact moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of quantile sketches, and the error of a rank that it gives (with 99 per cent).
SKETCH_K, RANK_ERROR = 400, 0.0075
#: Base-2 logarithm of the registers of a distinct sketch; the count's standard error is 1.04 / sqrt(2 ** LG).
LG = 14
MOMENTS = ("n", "nulls", "total", "lo", "hi")


def quantile(sketch: Column, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(p))


def profile(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """A row per group of by: n, nulls, total, mean square distance from the mean (m2), lo, hi and the two sketches of a numeric column.

    Groups are those in which data arrive (a day, a file); merged() makes profiles of larger ones without reading the rows again. A
    sketch is a few kilobytes, however many rows its group has.
    """
    x = F.col(column).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(x.isNull(), 1)).alias("nulls"), F.sum(x).alias("total"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        (F.var_pop(x) * F.count(x)).alias("m2"), F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias("quantiles"), F.hll_sketch_agg(x.cast("string"), F.lit(LG)).alias("distinct"),
    )


def merged(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of the groups of by, from profiles of parts of them. Moments are exact, and merged as if the rows had been read again."""
    met = F.col("n") - F.col("nulls")
    mean = F.sum("total") / F.nullif(F.sum(met), F.lit(0))
    # sum of squares about the mean: the parts' own, and their means' about the whole
    spread = F.sum("m2") + F.sum(F.when(met > 0, F.col("total") * F.col("total") / met)) - F.sum("total") * mean
    return profiles.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), spread.alias("m2"),
        F.kll_merge_agg_double(F.when(met > 0, F.col("quantiles"))).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"),
    )


def described(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The readable form: n, nulls, lo, median, mean, hi, variance, distinct_values. Median and distinct_values are approximate."""
    met = F.nullif(F.col("n") - F.col("nulls"), F.lit(0))
    return profiles.select(
        *by, "n", "nulls", "lo", F.when(met.isNotNull(), quantile(F.col("quantiles"), 0.5)).alias("median"), (F.col("total") / met).alias("mean"), "hi",
        (F.col("m2") / met).alias("variance"), F.hll_sketch_estimate("distinct").alias("distinct_values"),
    )
