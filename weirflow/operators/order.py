"""Verbs that follow the order of rows, without ever bringing all rows into one task.

``ranged`` sorts a table into ranges of its order columns, of any type with an order, and stores it: as many ranges as
the session has shuffle partitions, and up to 64 times as many where a range would exceed ``RANGE_BYTES``. Ties keep the order in which
the table has its rows, so many equal rows fill several ranges. A row's place in the whole is its place in its range
and the sizes of the ranges before, which are a small table; so are the sums and last values that cross ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.operators.stored import materialize, unused

RANGE_BYTES = 128 << 20
#: Up to this place, a row or a slice is found by keeping the least rows; beyond it, rows are numbered.
TOP = 100_000


class Ranged:
    """A stored table with a row's range in column ``part`` and its place there, from 0, in ``place``."""

    def __init__(self, df: DataFrame, order: list[str]):
        spark = df.sparkSession
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # Spark's own estimate, high where it knows little
        ranges = max(usual, min(size // RANGE_BYTES if size < 1 << 60 else 0, 64 * usual))
        self.part, self.place, tie = (unused(df, name) for name in ("part", "place", "tie"))
        keys = [*[F.col(c) for c in order], F.col(tie)]
        rows = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop(tie)
        part = F.spark_partition_id()
        self.rows = materialize(rows.select("*", part.alias(self.part), (F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)).alias(self.place)), "ranged")

    def before(self, value: Column, name: str) -> DataFrame:
        """Per range, the total of ``value`` over the ranges before it: a row for each range, so it may be broadcast."""
        per = self.rows.groupBy(self.part).agg(value.alias(name))
        w = W.orderBy(self.part).rowsBetween(W.unboundedPreceding, -1)
        return F.broadcast(per.select(self.part, F.coalesce(F.sum(name).over(w), F.lit(0)).alias(name)))

    def within(self):
        return W.partitionBy(self.part).orderBy(self.place)


def _new(df: DataFrame, name: str) -> str:
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return name


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Adds each row's place in the whole order, from 1."""
    _new(df, name)
    r = Ranged(df, order)
    start = unused(r.rows, "start")
    return r.rows.join(r.before(F.count(F.lit(1)), start), r.part).withColumn(name, F.col(start) + F.col(r.place) + 1).select(*df.columns, name)


def take(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tailn(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def _by_number(df: DataFrame, order: list[str], keep) -> DataFrame:
    n = unused(df, "n")
    return numbered(df, order, n).filter(keep(F.col(n))).drop(n)


def drop(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """All rows after the first n, without a global sort of what stays."""
    return _by_number(df, order, lambda k: k > n)


def first(df: DataFrame, order: list[str]) -> DataFrame:
    return take(df, order, 1)


def last(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(1)


def nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n-th row; 0 behaves as 1."""
    return index(df, order, max(n, 1))


def index(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n-th row; none for 0."""
    return slice_rows(df, order, n, n) if n > 0 else df.limit(0)


def slice_rows(df: DataFrame, order: list[str], a: int = 1, b: int | None = None) -> DataFrame:
    """Rows a to b, from 1, both included."""
    a = max(a, 1)
    if b is not None and b < a:
        return df.limit(0)
    if b is not None and b <= TOP:
        return df.orderBy(*order).offset(a - 1).limit(b - a + 1)
    return _by_number(df, order, lambda k: (k >= a) & (F.lit(True) if b is None else k <= b))


def every(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every n-th row; 0 keeps all."""
    return df if n == 0 else _by_number(df, order, lambda k: k % n == 0)


def reverse(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order])


def unique_by(df: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """The first row of each key: one partial minimum per task and key, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def previous(df: DataFrame, order: list[str], value: str, name: str, is_first: str) -> DataFrame:
    """Adds the value of the row before, null at the first row, and whether it is the first; ranges hand on their last values."""
    _new(df, name), _new(df, is_first)
    r = Ranged(df, order)
    carry, last = unused(r.rows, "carry"), unused(r.rows, "last")
    boxed = F.struct(F.col(value).alias("v"))
    ends = r.rows.groupBy(r.part).agg(F.max_by(boxed, r.place).alias(last))
    ends = ends.select(r.part, F.lag(last).over(W.orderBy(r.part)).alias(carry))
    found = F.coalesce(F.lag(boxed).over(r.within()), F.col(carry))
    rows = r.rows.join(F.broadcast(ends), r.part)  # a row for each range
    return rows.withColumn(last, found).select(*df.columns, F.col(last)["v"].alias(name), F.col(last).isNull().alias(is_first))


def dedup(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adjacent equal values once."""
    before, is_first = unused(df, "before"), unused(df, "is_first")
    return previous(df, order, value, before, is_first).filter(F.col(is_first) | ~F.col(value).eqNullSafe(F.col(before))).drop(before, is_first)


def delta(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds delta, the difference to the row before; the first row goes. Rows without a number are left out first."""
    _new(df, "delta")
    before, is_first = unused(df, "before"), unused(df, "is_first")
    p = previous(df.filter(F.col(value).isNotNull()), order, value, before, is_first)
    return p.filter(~F.col(is_first)).withColumn("delta", F.col(value) - F.col(before)).drop(before, is_first)


def cumsum(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds cumsum, the running total."""
    _new(df, "cumsum")
    r = Ranged(df.filter(F.col(value).isNotNull()), order)
    start = unused(r.rows, "start")
    own = F.sum(value).over(r.within().rowsBetween(W.unboundedPreceding, 0))
    return r.rows.join(r.before(F.sum(value), start), r.part).withColumn("cumsum", F.col(start) + own).select(*df.columns, "cumsum")


def sma(df: DataFrame, order: list[str], value: str, n: int) -> DataFrame:
    """Adds sma, the mean of the last n rows (fewer at the start); blocks of rows carry the n - 1 rows before them."""
    _new(df, "sma")
    n = max(n, 1)
    size = max(n, 1 << 16)
    at, own, block = (unused(df, name) for name in ("at", "own", "block"))
    rows = numbered(df.filter(F.col(value).isNotNull()), order, at).withColumn(own, F.floor((F.col(at) - 1) / size))
    halo = F.when((F.col(at) - 1) % size >= size - n + 1, F.array(own, F.col(own) + 1)).otherwise(F.array(own))
    w = W.partitionBy(block).orderBy(at).rowsBetween(1 - n, 0)
    return rows.withColumn(block, F.explode(halo)).withColumn("sma", F.avg(value).over(w)).filter(F.col(block) == F.col(own)).select(*df.columns, "sma")


def ewma(df: DataFrame, order: list[str], value: str, a: float) -> DataFrame:
    """Adds ewma: s = a x + (1 - a) s, starting at the first row; ranges are folded by themselves and then joined up."""
    a = min(max(a, 0.0), 1.0)
    return folded(df, order, value, "ewma", lambda s, x: x if s is None else a * x + (1 - a) * s, lambda s, x0, n, end: end + (1 - a) ** n * (s - x0))


def folded(df: DataFrame, order: list[str], value: str, name: str, step, shift) -> DataFrame:
    """Adds the states of a fold over numbers in order, ``step(state or None, x)``.

    Each range is folded from nothing first; ``shift(s, x0, n, end)`` tells the end of a range of ``n`` numbers, which
    starting with ``x0`` from nothing ends at ``end``, when the state before it is ``s``. Its start then is known, and
    it is folded once more.
    """
    import numpy as np
    import pyarrow as pa

    _new(df, name)
    r = Ranged(df.filter(F.col(value).isNotNull()), order)
    part, place = r.part, r.place

    def run(x: np.ndarray, start: float | None) -> np.ndarray:
        out, s = np.empty(len(x)), start
        for k, v in enumerate(x.tolist()):
            out[k] = s = step(s, v)
        return out

    def summary(key: tuple, t: pa.Table) -> pa.Table:
        x = t.sort_by(place)[value].to_numpy().astype(float)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": [len(x)], "x0": [float(x[0])], "last": [float(run(x, None)[-1])]})

    each = r.rows.select(part, place, value).groupBy(part).applyInArrow(summary, "part int, n bigint, x0 double, last double").collect()  # a row for each range
    starts, s = {}, None
    for row in sorted(each, key=lambda e: e["part"]):
        starts[row["part"]] = s
        s = row["last"] if s is None else shift(s, row["x0"], row["n"], row["last"])

    def states(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by(place)
        return t.select(columns).append_column(name, pa.array(run(t[value].to_numpy().astype(float), starts[key[0].as_py()])))

    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"
    return r.rows.groupBy(part).applyInArrow(states, schema)


def sort_lines(df: DataFrame, value: str, order: list[str], numeric: bool = False, reverse: bool = False) -> DataFrame:
    """By bytes, or by each line's first word as a number with other lines last; ``reverse`` turns ties round too."""
    from weirflow.functions.text import field_at, num

    keys = [F.col(value), *[F.col(c) for c in order]]
    if numeric:
        keys = [num(field_at(value, 1)), *[F.col(c) for c in order]]
    return df.orderBy(*[k.desc_nulls_first() if reverse else k.asc_nulls_last() for k in keys])
