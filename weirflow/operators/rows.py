"""Verbs that make several rows of one. Each keeps ``ord`` and adds the place within the row as ``sub``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import json as J
from weirflow.functions import text as T


def explode_to(df: DataFrame, array: Column, name: str = "value", keep: list[str] | None = None) -> DataFrame:
    keep = [c for c in df.columns if c != name] if keep is None else keep
    return df.select(*keep, F.posexplode(array).alias("sub", name))


def words(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return explode_to(df, T.words(column), keep=keep)


def split(df: DataFrame, column: str, delimiter: str, keep: list[str]) -> DataFrame:
    return explode_to(df, T.split_on(column, delimiter), keep=keep)


def chars(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return explode_to(df, F.filter(F.split(F.col(column), ""), lambda c: c != ""), keep=keep)


def each(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """An array's elements or an object's values; other lines pass."""
    return explode_to(df, F.coalesce(J.elements(column), F.array(column)), keep=keep)


def keys(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return explode_to(df, F.coalesce(J.keys(column), F.array(column)), keep=keep)


def entries(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return explode_to(df, F.coalesce(J.entries(column), F.array(column)), keep=keep)
