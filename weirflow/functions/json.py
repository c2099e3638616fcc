"""Column functions of the JSON verbs, on VARIANT: a line is parsed once and its parts are read in the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.text import as_column, fmt_num, once


def parsed(x: Column | str) -> Column:
    """The line as a VARIANT, null where it is no JSON."""
    return F.try_parse_json(as_column(x))


def at(x: Column | str, *path: str | int, kind: str = "string") -> Column:
    """The value at a path of keys and indices, null where there is none; a negative index counts from the end."""
    v = parsed(x)
    for k, step in enumerate(path):
        if isinstance(step, int) and step < 0:
            v = F.try_element_at(F.try_variant_get(v, "$", "array<variant>"), F.lit(step))
        elif isinstance(step, int) or "'" not in step:
            v = F.try_variant_get(v, f"$[{step}]" if isinstance(step, int) else f"$['{step}']", "variant")
        elif '"' not in step:
            v = F.try_variant_get(v, f'$["{step}"]', "variant")
        else:  # a path can't spell both quotes
            v = F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(step))
    return F.try_variant_get(v, "$", kind)


def first_char(x: Column | str) -> Column:
    """A line's first character after JSON's white space: where the line is JSON, it tells the value's type."""
    return F.substring(F.ltrim(as_column(x), F.lit(" \t\r\n")), 1, 1)


def is_object(x: Column | str) -> Column:
    return F.coalesce((first_char(x) == "{") & parsed(x).isNotNull(), F.lit(False))


def keys(x: Column | str) -> Column:
    """Sorted keys of an object, null for anything else."""
    return F.when(is_object(x), F.array_sort(F.json_object_keys(as_column(x))))


def has_key(x: Column | str, key: str) -> Column:
    return F.coalesce(F.array_contains(keys(x), key), F.lit(False))


def as_map(x: Column | str) -> Column:
    """An object's values as JSON text by key."""
    return F.when(is_object(x), F.transform_values(F.try_variant_get(parsed(x), "$", "map<string,variant>"), lambda _, v: F.to_json(v)))


def object_of(values: Column) -> Column:
    """JSON text of a map of JSON texts, keys sorted."""
    entries = F.array_sort(F.map_entries(values))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def quoted(x: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def _edit(x: Column | str, change) -> Column:
    """An object with its map changed; other lines, and those for which ``change`` gives null, as they are."""
    return once(x, lambda v: F.coalesce(once(as_map(v), lambda m: F.when(m.isNotNull(), object_of(change(m)))), v))


def set_key(x: Column | str, key: str, value: str) -> Column:
    return _edit(x, lambda m: F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), quoted(F.lit(value)))))


def del_key(x: Column | str, key: str) -> Column:
    return _edit(x, lambda m: F.map_filter(m, lambda k, _: k != key))


def rename_key(x: Column | str, old: str, new: str) -> Column:
    moved = lambda m: F.map_concat(F.map_filter(m, lambda k, _: ~k.isin(old, new)), F.create_map(F.lit(new), F.element_at(m, F.lit(old))))
    return _edit(x, lambda m: F.when(F.map_contains_key(m, old), moved(m)))


def default_key(x: Column | str, key: str, value: str) -> Column:
    return _edit(x, lambda m: F.when(~F.map_contains_key(m, key), F.map_concat(m, F.create_map(F.lit(key), quoted(F.lit(value))))))


def pick_keys(x: Column | str, *names: str) -> Column:
    """Only these keys, in this order, those that are there."""
    def chosen(m: Column) -> Column:
        parts = [F.when(F.map_contains_key(m, n), F.concat(quoted(F.lit(n)), F.lit(":"), F.element_at(m, F.lit(n)))) for n in names]
        return F.when(m.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))

    return once(x, lambda v: F.coalesce(once(as_map(v), chosen), v))


def entries(x: Column | str) -> Column:
    """An array of {"key":..,"value":..} texts, by key."""
    pairs = F.array_sort(F.map_entries(as_map(x)))
    return F.transform(pairs, lambda e: F.concat(F.lit('{"key":'), quoted(e["key"]), F.lit(',"value":'), e["value"], F.lit("}")))


def elements(x: Column | str) -> Column:
    """JSON texts of an array's elements, or of an object's values by key; null for anything else."""
    array = F.try_variant_get(parsed(x), "$", "array<variant>")
    return F.coalesce(F.transform(array, lambda v: F.to_json(v)), F.map_values(as_map(x)))


def json_length(x: Column | str) -> Column:
    """Size of an array or object, characters of a string, size of a number, 0 of null; else the line's characters."""
    kind, v = F.schema_of_variant(parsed(x)), parsed(x)
    return (
        F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")).cast("double"))
        .when(kind.startswith("OBJECT"), F.size(keys(x)).cast("double"))
        .when(kind == "STRING", F.length(F.try_variant_get(v, "$", "string")).cast("double"))
        .when(kind == "VOID", F.lit(0.0))
        .when(kind == "BOOLEAN", F.length(as_column(x)).cast("double"))
        .when(kind.isNotNull(), F.abs(F.try_variant_get(v, "$", "double")))
        .otherwise(F.length(as_column(x)).cast("double"))
    )


def array_slice(x: Column | str, a: int | None = None, b: int | None = None) -> Column:
    """Elements (or characters of a string) a to b, end exclusive, negative ones from the end, as JSON text; null for others."""
    array = F.try_variant_get(parsed(x), "$", "array<variant>")
    string = F.when(F.schema_of_variant(parsed(x)) == "STRING", F.try_variant_get(parsed(x), "$", "string"))

    def bounds(n: Column) -> tuple[Column, Column]:
        place = lambda k, default: default if k is None else F.greatest(n + k, F.lit(0)) if k < 0 else F.least(F.lit(k), n)
        low, high = place(a, F.lit(0)), place(b, n)
        return low, F.greatest(high - low, F.lit(0))

    low, size = bounds(F.size(array))
    part = F.transform(F.slice(array, low + 1, size), lambda v: F.to_json(v))
    start, length = bounds(F.length(string))
    return F.coalesce(F.concat(F.lit("["), F.array_join(part, ","), F.lit("]")), F.when(string.isNotNull(), quoted(F.substring(string, start + 1, length))))


def array_add(x: Column | str) -> Column:
    """The sum of an array of numbers as text, else its parts joined; empty for an empty one; other lines pass."""
    def added(array: Column) -> Column:
        number = lambda v: F.when(F.schema_of_variant(v) != "STRING", F.try_variant_get(v, "$", "double"))
        total = F.aggregate(array, F.lit(0.0), lambda s, v: s + number(v))
        texts = F.transform(array, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
        return F.when(F.size(array) == 0, "").otherwise(once(total, lambda t: F.when(t.isNotNull(), fmt_num(t)).otherwise(F.array_join(texts, ""))))

    array = lambda v: F.try_variant_get(parsed(v), "$", "array<variant>")
    return once(x, lambda v: once(array(v), lambda a: F.when(a.isNull(), v).otherwise(added(a))))


def leaves(x: Column | str) -> Column:
    """All leaves of an array, at every depth, as JSON texts; null for anything else. Depth has no bound, hence Python."""
    def walk(value: object, out: list[str]) -> list[str]:
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack += reversed(v)
            else:
                out.append(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        return out

    def one(line: str | None) -> list[str] | None:
        try:
            value = json.loads(line or "")
        except (ValueError, RecursionError):
            return None
        return walk(value, []) if isinstance(value, list) else None

    @F.pandas_udf("array<string>")
    def flat(lines: pd.Series) -> pd.Series:
        return lines.map(one)

    return flat(as_column(x))
