"""Results as text, JSON or Parquet, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_text(df: DataFrame) -> DataFrame:
    """(value): the columns of each row with tabs between."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object; times keep their microseconds."""
    row: Column = F.struct(*df.columns)
    return df.select(F.to_json(row, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    as_text(df).write.text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    as_json(df).write.text(path)
