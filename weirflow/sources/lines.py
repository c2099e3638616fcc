"""Lines with their order, and records in lines.

``ord`` is an array: file, offset of the split in the file, place in the split. It sorts as the files' order and needs
no shuffle to make. Formats that Spark reads natively (CSV, TSV, JSON, Parquet, ORC) are read by Spark's own readers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.text import as_column


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(ord, value) of text files; ``separator`` may be a zero character."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    df = reader.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return df.select(F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("k")).alias("ord"), "value")


def csv(spark: SparkSession, path: str, separator: str = ",", multiline: bool = True) -> DataFrame:
    """Records of strings with the first line as header; unquoted cells are trimmed. Quotes may span lines where ``multiline``, at a task for each file; else large files are split."""
    return spark.read.csv(path, sep=separator, header=True, multiLine=multiline, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False)


def csv_lines(df: DataFrame, header: list[str], separator: str = ",", column: str = "value") -> DataFrame:
    """Records of lines that are already in a table; short rows are filled with empty strings, extra cells dropped."""
    schema = ", ".join(f"`{h}` STRING" for h in header)
    options = {"sep": separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"}
    parsed = F.from_csv(F.col(column), schema, options)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, parsed.alias("_r")).select(*rest, *[F.coalesce(F.col("_r").getField(h), F.lit("")).alias(h) for h in header])


def logfmt(x: Column | str, key: str) -> Column:
    """The value of ``key=value`` or ``key="quoted value"``, the first one; null where there is none."""
    line = as_column(x)
    name = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in key)
    quoted = F.regexp_extract(line, rf'(?:^|\s){name}="((?:[^"\\]|\\.)*)"', 1)
    plain = F.regexp_extract(line, rf'(?:^|\s){name}=([^\s"]*)', 1)
    unescaped = F.regexp_replace(quoted, r"\\(.)", "$1")
    return F.when(line.rlike(rf'(?:^|\s){name}="'), unescaped).when(line.rlike(rf"(?:^|\s){name}="), plain)


def field(x: Column | str, *path: str | int) -> Column:
    """A field of a line: a JSON path, else for a single name logfmt, else empty."""
    from weirflow.functions import json as J

    found = J.at(x, *path)
    if len(path) == 1 and isinstance(path[0], str):
        found = F.coalesce(found, logfmt(x, path[0]))
    return F.coalesce(found, F.lit(""))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row for each file, for formats that need the whole of it."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def _documents(df: DataFrame, column: str, parse) -> DataFrame:
    """(keys..., sub, value): a JSON line for each document in each row; rows that don't parse give none."""
    rest = [c for c in df.columns if c != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sub, values = [], [], []
            for k, text in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                for j, value in enumerate(parse(text or "")):
                    rows.append(k)
                    sub.append(j)
                    values.append(value)
            kept = batch.select(rest).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sub, pa.int32()), pa.array(values, pa.string())], [*rest, "sub", "value"])

    return df.mapInArrow(run, (schema + ", " if schema else "") + "sub int, value string")


def toml(df: DataFrame, column: str = "value") -> DataFrame:
    """One JSON line for each TOML document; dates become strings."""

    def parse(text: str) -> list[str]:
        import json
        import tomllib

        try:
            return [json.dumps(tomllib.loads(text), default=lambda d: d.isoformat().replace("+00:00", "Z"), sort_keys=True, separators=(",", ":"), ensure_ascii=False)]
        except (tomllib.TOMLDecodeError, ValueError):
            return []

    return _documents(df, column, parse)


def yaml(df: DataFrame, column: str = "value") -> DataFrame:
    """A JSON line for each YAML document that parses and isn't null; merge keys are resolved. Needs PyYAML."""

    def parse(text: str) -> list[str]:
        import json
        import re

        import yaml as reader

        out = []
        for part in re.split(r"(?m)^---(?:[ \t].*)?$", text):
            try:
                found = reader.safe_load(part)
                if found is not None:
                    out.append(json.dumps(found, default=str, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            except (reader.YAMLError, TypeError):
                continue
        return out

    return _documents(df, column, parse)


def sniff(df: DataFrame, column: str = "value") -> str:
    """The likely format of a table of lines by its first eight: json, logfmt, csv, tsv or text."""
    head = [r[0].strip() for r in df.select(column).limit(8).collect() if r[0] and r[0].strip()]
    if not head:
        return "text"
    share = lambda test: sum(map(test, head)) > len(head) / 2
    if share(lambda s: s.startswith("{") and s.endswith("}")):
        return "json"
    if share(lambda s: sum("=" in w for w in s.split()) >= 2):
        return "logfmt"
    for name, mark in (("tsv", "\t"), ("csv", ",")):
        counts = {s.count(mark) for s in head}
        if counts and min(counts) > 0 and len(counts) == 1:
            return name
    return "text"
