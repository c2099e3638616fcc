"""Verbs over lines that may be records: a field is a column of words (a number, 0 the whole line) or a key of a JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import json as J
from weirflow.functions.text import field_at, fmt_num, num


def picked(value: str, field: int | str) -> Column:
    """A line's field as text; null where a line has no such key."""
    return field_at(value, field) if isinstance(field, int) else J.at(value, field)


def grepf(df: DataFrame, value: str, field: int | str, pattern: str) -> DataFrame:
    """Lines whose field matches; a line without it does not."""
    return df.filter(F.coalesce(picked(value, field).rlike(pattern), F.lit(False)))


def where_number(df: DataFrame, value: str, keep, field: int | str = 0) -> DataFrame:
    """Lines whose field is a number that ``keep`` takes; other lines go."""
    return df.filter(F.coalesce(keep(num(picked(value, field))), F.lit(False)))


def over(df: DataFrame, value: str, n: float, field: int | str = 0) -> DataFrame:
    return where_number(df, value, lambda x: x > n, field)


def under(df: DataFrame, value: str, n: float, field: int | str = 0) -> DataFrame:
    return where_number(df, value, lambda x: x < n, field)


def between(df: DataFrame, value: str, low: float, high: float, field: int | str = 0) -> DataFrame:
    """Both ends belong."""
    return where_number(df, value, lambda x: x.between(low, high), field)


def change_number(df: DataFrame, value: str, change) -> DataFrame:
    """Lines that are numbers changed and written anew, other lines as they are: abs, floor, ceil, round and the like."""
    x = num(value)
    return df.withColumn(value, F.when(x.isNull(), F.col(value)).otherwise(fmt_num(change(x).cast("double"))))


def sort_keys(value: str, key: str) -> list[Column]:
    """Objects with a number by the key first, then those with other values by their text, then those without; lines that are no object last."""
    def keys_of(line: Column) -> Column:
        group = lambda f, x: F.when(~J.is_object(line) | line.isNull(), 3).when(x.isNotNull(), 0).when(f.isNotNull(), 1).otherwise(2)
        named = lambda f, x, g: F.struct(g.alias("group"), x.alias("number"), F.when(g == 1, f).alias("text"))
        return J.once(J.at(line, key), lambda f: J.once(num(f), lambda x: J.once(group(f, x), lambda g: named(f, x, g))))

    all_keys = J.once(value, keys_of)
    return [all_keys[name] for name in ("group", "number", "text")]


def sort_by(df: DataFrame, value: str, key: str, order: list[str]) -> DataFrame:
    """By ``sort_keys``, ties in ``order``."""
    return df.orderBy(*sort_keys(value, key), *order)
