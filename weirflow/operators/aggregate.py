"""Reducers and groupings. All are partial sums per task and one small exchange; empty input has the given value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(df: DataFrame, column: str) -> DataFrame:
    """(key, count) by falling count, then key."""
    return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "key")


def count_by(df: DataFrame, field: str) -> DataFrame:
    """As ``tally`` on a field; rows without it count under the empty key."""
    return tally(df.select(F.coalesce(F.col(field).cast("string"), F.lit("")).alias(field)), field)


def group_by(df: DataFrame, key: str, member: str, order: list[str]) -> DataFrame:
    """(key, members): members in input order. The one verb whose result has a row as long as its group."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(member).alias("_m"))))
    return df.groupBy(F.col(key).alias("key")).agg(F.transform(rows, lambda r: r["_m"]).alias("members")).orderBy("key")


#: name -> aggregate over a number column, with its value over no rows
REDUCERS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "min": lambda c: F.coalesce(F.min(c), F.lit(0.0)),
    "max": lambda c: F.coalesce(F.max(c), F.lit(0.0)),
    "avg": lambda c: F.coalesce(F.avg(c), F.lit(0.0)),
    "median": lambda c: F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0)),
    "stddev": lambda c: F.coalesce(F.stddev_pop(c), F.lit(0.0)),
    "range": lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0)),
    "product": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
}


def reduce(df: DataFrame, name: str, column: Column | str) -> DataFrame:
    """One row (value) of a reducer; NaN counts as no number."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return df.select(F.when(~F.isnan(c), c).alias("x")).agg(REDUCERS[name](F.col("x")).alias("value"))


def percentile(df: DataFrame, column: str, p: float) -> DataFrame:
    """Exact, with linear interpolation; p from 0 to 100."""
    c = F.col(column).cast("double")
    return df.agg(F.coalesce(F.percentile(c, F.lit(min(max(p, 0.0), 100.0) / 100)), F.lit(0.0)).alias("value"))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value"))


def distinct(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("value"))


def rate(df: DataFrame, elapsed: float) -> DataFrame:
    """Rows a second."""
    return df.agg((F.count(F.lit(1)) / F.lit(max(elapsed, 0.001))).alias("value"))


def calc(df: DataFrame, expression) -> DataFrame:
    """An expression of the number of rows."""
    return df.agg(F.count(F.lit(1)).cast("double").alias("x")).select(expression(F.col("x")).alias("value"))


def min_by(df: DataFrame, field: str, order: list[str]) -> DataFrame:
    """The row with the smallest number, the first of equal ones; none without numbers."""
    return _extreme(df, F.min_by, field, order)


def max_by(df: DataFrame, field: str, order: list[str]) -> DataFrame:
    """The row with the largest number, the last of equal ones."""
    return _extreme(df, F.max_by, field, order)


def _extreme(df: DataFrame, pick, field: str, order: list[str]) -> DataFrame:
    rows = df.filter(F.col(field).isNotNull())
    return rows.agg(pick(F.struct(*df.columns), F.struct(field, *order)).alias("r")).filter("r IS NOT NULL").select("r.*")


def bins(df: DataFrame, column: str, n: int) -> DataFrame:
    """(low, high, count) of n equal parts from least to largest, empty ones too; equal values all fall in the first."""
    n = min(max(n, 1), 65536)
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / n
    bin_no = F.when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(n - 1)))
    counted = x.join(F.broadcast(ends)).groupBy(bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = ends.filter("lo IS NOT NULL").select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    low = F.col("lo") + F.col("bin") * F.col("w")
    return all_bins.join(counted, "bin", "left").select("bin", low.alias("low"), (low + F.col("w")).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def merge(df: DataFrame, values: Column, order: list[str]) -> DataFrame:
    """(key, value): of a map column's entries over all rows, the last of each key."""
    each = df.select(*order, F.explode(values).alias("key", "value"))
    return each.groupBy("key").agg(F.max_by("value", F.struct(*order)).alias("value"))


def join_lines(df: DataFrame, column: str, order: list[str], separator: str = " ") -> DataFrame:
    """One row with all values joined in order: for results, as its row grows with its input."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_v"))))
    return df.agg(F.coalesce(F.array_join(F.transform(rows, lambda r: r["_v"]), separator), F.lit("")).alias("value"))


def facet(df: DataFrame, field: str, order: list[str], n: int = 32) -> DataFrame:
    """(key): the first n distinct values that aren't empty, in order of their first row."""
    seen = df.select(F.col(field).cast("string").alias("key"), *order).filter("key <> ''")
    return seen.groupBy("key").agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first").limit(n).select("key")


def sparkline(df: DataFrame, value: str, order: list[str], n: int = 400) -> DataFrame:
    """(value): the last n numbers as eight levels between their least and largest, one character each."""
    rows = df.filter(F.col(value).isNotNull()).orderBy(*[F.desc(c) for c in order]).limit(n)
    series = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))), lambda r: r["_v"])
    one = rows.agg(series.alias("x")).select("x", F.array_min("x").alias("lo"), F.array_max("x").alias("hi"))
    bars = F.split(F.lit("▁▂▃▄▅▆▇█"), "")
    level = lambda v: F.coalesce(F.round(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")) * 7), F.lit(0)).cast("int")
    return one.select(F.array_join(F.transform("x", lambda v: F.get(bars, level(v))), "").alias("value"))
