"""JSON values of any type, as text columns: their total order, truth, and arithmetic over types.

The order is null < false < true < numbers < strings < arrays < objects. Numbers are doubles. An operation that has no
result for its types, or divides by zero, gives null, and ``failed`` tells which rows those are; a line that is no JSON
counts as a string.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.json import elements, first_char, keys, object_of, once, parsed, quoted
from weirflow.functions.json import as_map as map_of
from weirflow.functions.text import as_column, fmt_num

KINDS = ("null", "boolean", "number", "string", "array", "object")


def kind(x: Column | str) -> Column:
    """The name of a value's type; null for a null column."""
    return once(x, lambda v: _kind(v, parsed(v).isNotNull()))


def _kind(x: Column, is_json: Column) -> Column:
    named = lambda c: F.when(c == "n", "null").when(c.isin("t", "f"), "boolean").when(c == "[", "array").when(c == "{", "object").when(c == '"', "string").otherwise("number")
    return F.when(x.isNull(), F.lit(None)).when(is_json, once(first_char(x), named)).otherwise("string")


def number(x: Column | str) -> Column:
    return _typed(x)["number"]


def text(x: Column | str) -> Column:
    """A string's characters, without its quotes."""
    return _typed(x)["text"]


def truthy(x: Column | str) -> Column:
    """All but null and false; a null column is false."""
    true = lambda v, k: (k != "null") & ~((k == "boolean") & (F.trim(v) == "false"))
    return F.coalesce(once(x, lambda v: once(kind(v), lambda k: true(v, k))), F.lit(False))


def _scalar(x: Column | str) -> Column:
    def parts(t: Column) -> Column:
        k, raw = t["kind"], t["raw"]
        rank = F.when(k == "null", 0).when(k == "boolean", F.when(F.trim(raw) == "true", 2).otherwise(1)).when(k == "number", 3).when(k == "string", 4).when(k == "array", 5).otherwise(6)
        return F.struct(rank.alias("rank"), t["number"].alias("number"), t["text"].alias("text"), F.when(k.isin("array", "object"), raw).alias("rest"))

    return once(_typed(x), parts)


def order_key(x: Column | str) -> Column:
    """A key that sorts and compares as the values do: arrays by their elements, objects by their keys, then by their values; what is nested deeper by its text."""
    def key(v: Column) -> Column:
        parts = F.when(kind(v).isin("array", "object"), F.transform(elements(v), _scalar))
        whole = lambda own: F.struct(own["rank"].alias("rank"), own["number"].alias("number"), own["text"].alias("text"), keys(v).alias("keys"), parts.alias("parts"))
        return F.when(v.isNotNull(), once(_scalar(v), whole))

    return once(x, key)


def _typed(x: Column | str) -> Column:
    """Type, number, characters and text of a value."""
    def parts(v: Column, p: Column, k: Column) -> Column:
        own = F.when(k == "string", F.coalesce(F.try_variant_get(p, "$", "string"), v))
        return F.struct(k.alias("kind"), F.when(k == "number", F.try_variant_get(p, "$", "double")).alias("number"), own.alias("text"), v.alias("raw"))

    return once(x, lambda v: once(parsed(v), lambda p: once(_kind(v, p.isNotNull()), lambda k: parts(v, p, k))))


def _bound(operation):
    """The operation on two typed inputs, each computed one time."""
    @wraps(operation)
    def bound(a: Column | str, b: Column | str) -> Column:
        return once(_typed(a), lambda x: once(_typed(b), lambda y: operation(x, y)))

    return bound


def _of_array(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _both(a: Column, b: Column, name: str) -> Column:
    return (a["kind"] == name) & (b["kind"] == name)


def _shown(x: Column) -> Column:
    return once(x, fmt_num)


@_bound
def plus(a: Column, b: Column) -> Column:
    """Null adds nothing; numbers, strings and arrays add up; of objects' equal keys the second value stays."""
    merged = once(map_of(b["raw"]), lambda m: object_of(F.map_concat(F.map_filter(map_of(a["raw"]), lambda k, _: ~F.map_contains_key(m, k)), m)))
    return (
        F.when(a["kind"] == "null", b["raw"]).when(b["kind"] == "null", a["raw"])
        .when(_both(a, b, "number"), _shown(a["number"] + b["number"]))
        .when(_both(a, b, "string"), quoted(F.concat(a["text"], b["text"])))
        .when(_both(a, b, "array"), _of_array(F.concat(elements(a["raw"]), elements(b["raw"]))))
        .when(_both(a, b, "object"), merged)
    )


@_bound
def minus(a: Column, b: Column) -> Column:
    """Numbers; of an array the elements that the other has not."""
    left = once(F.transform(elements(b["raw"]), _scalar), lambda other: _of_array(F.filter(elements(a["raw"]), lambda e: ~F.array_contains(other, _scalar(e)))))
    return F.when(_both(a, b, "number"), _shown(a["number"] - b["number"])).when(_both(a, b, "array"), left)


@_bound
def times(a: Column, b: Column) -> Column:
    """Numbers; a string so many times, null for none."""
    def repeated(s: Column, n: Column) -> Column:
        return F.when(n["number"] > 0, quoted(F.repeat(s["text"], F.greatest(F.floor(n["number"]).cast("int"), F.lit(1))))).otherwise("null")

    return (
        F.when(_both(a, b, "number"), _shown(a["number"] * b["number"]))
        .when((a["kind"] == "string") & (b["kind"] == "number"), repeated(a, b))
        .when((a["kind"] == "number") & (b["kind"] == "string"), repeated(b, a))
    )


@_bound
def over(a: Column, b: Column) -> Column:
    """Numbers, not by zero; a string split at another, into characters at an empty one."""
    literal = F.concat(F.lit("\\Q"), F.replace(b["text"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.when(b["text"] == "", F.filter(F.split(a["text"], ""), lambda c: c != "")).otherwise(F.split(a["text"], literal, F.lit(-1)))
    return F.when(_both(a, b, "number") & (b["number"] != 0), _shown(F.try_divide(a["number"], b["number"]))).when(_both(a, b, "string"), _of_array(F.transform(parts, quoted)))


@_bound
def modulo(a: Column, b: Column) -> Column:
    """Of numbers cut to whole ones; the sign is the first's; none by zero."""
    most = F.lit((1 << 63) - 1)
    whole = lambda x: F.coalesce(x["number"].try_cast("bigint"), F.when(x["number"] > 0, most).otherwise(-most))
    return once(F.when(_both(a, b, "number"), whole(b)), lambda by: F.when(by != 0, _shown((whole(a) % by).cast("double"))))


def failed(result: Column, *inputs: Column | str) -> Column:
    """Whether an operation had inputs and no result: the rows on which a strict run would stop."""
    there = F.lit(True)
    for x in inputs:
        there = there & as_column(x).isNotNull()
    return there & result.isNull()


def to_entries(x: Column | str) -> Column:
    """``[{"key":..,"value":..}]`` of an object, null for anything else."""
    from weirflow.functions.json import entries

    return F.when(kind(x) == "object", _of_array(entries(x)))


def mapped(x: Column | str, change) -> Column:
    """An array with each element (an object: each value) changed by a function of JSON text; elements without a result go."""
    changed = lambda v: _of_array(F.filter(F.transform(elements(v), change), lambda e: e.isNotNull()))
    return once(x, lambda v: once(kind(v), lambda k: F.when(k.isin("array", "object"), changed(v))))
