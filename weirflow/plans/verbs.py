"""One query for each verb over the given tables, with the SQL that gives the same rows.

``QUERIES`` maps a name to (function of (spark, sf_dir), SQL or None). Scalars have one row ``value``; groupings have
``key`` and ``count``; row verbs keep the table's key beside their result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import json as J
from weirflow.functions import text as T
from weirflow.functions import values as V
from weirflow.operators import aggregate as A
from weirflow.operators import fuzzy as Z
from weirflow.operators import html as H
from weirflow.operators import order as O
from weirflow.operators import records as RV
from weirflow.operators import rows as R
from weirflow.sources import lines as L
from weirflow.streaming import live as S

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = (lambda spark, sf_dir: make(_table(spark, sf_dir, table)), sql)


def _filter(name: str, table: str, keep: list[str], condition: Column | Callable[[], Column], sql: str) -> None:
    """A filter of a table; Spark's columns can only be made with a session, hence the function."""
    _add(name, table, lambda df: df.filter(condition()).select(*keep), f"SELECT {', '.join(keep)} FROM {table} WHERE {sql}")


def _map(name: str, table: str, key: str, value: Callable[[], Column], sql: str) -> None:
    _add(name, table, lambda df: df.select(key, value().alias("value")), f"SELECT {key}, {sql} AS value FROM {table}")


C = F.col
TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

# ---------------------------------------------------------------- filters
_filter("match", "part", ["p_partkey", "p_name"], lambda: C("p_name").rlike("(?i)B(o|l)"), "regexp_matches(p_name, '(?i)B(o|l)')")
_filter("reject", "part", ["p_partkey", "p_name"], lambda: ~C("p_name").rlike("[aeiou]r"), "NOT regexp_matches(p_name, '[aeiou]r')")
_filter("grepf", "part", ["p_partkey", "p_brand"], lambda: C("p_brand").rlike("#[12]$|#.3"), "regexp_matches(p_brand, '#[12]$|#.3')")
_filter("contains", "part", ["p_partkey"], lambda: C("p_name").contains("an"), "contains(p_name, 'an')")
_filter("starts", "customer", ["c_custkey"], lambda: C("c_name").startswith("Customer#00000001"), "starts_with(c_name, 'Customer#00000001')")
_filter("ends", "customer", ["c_custkey"], lambda: C("c_name").endswith("7"), "ends_with(c_name, '7')")
_filter("nonempty", "documents", ["doc_id"], lambda: T.utrim("text") != "", f"{TRIM.format('text')} <> ''")
_filter("numeric", "events", ["event_id"], lambda: T.num(C("value").cast("string")).isNotNull(), "value IS NOT NULL AND NOT isnan(value)")
_filter("over", "customer", ["c_custkey", "c_acctbal"], lambda: C("c_acctbal") > 5000, "c_acctbal > 5000")
_filter("under", "customer", ["c_custkey", "c_acctbal"], lambda: C("c_acctbal") < 0, "c_acctbal < 0")
_filter("between", "customer", ["c_custkey", "c_acctbal"], lambda: C("c_acctbal").between(100, 900.5), "c_acctbal BETWEEN 100 AND 900.5")
_add("where_compound", "lineitem", lambda df: A.count(df.filter((C("l_quantity") > 30) & C("l_discount").between(0.05, 0.07))), "SELECT count(*) AS value FROM lineitem WHERE l_quantity > 30 AND l_discount BETWEEN 0.05 AND 0.07")
_filter("where_in_list", "nation", ["n_name"], lambda: C("n_regionkey").isin(1, 3), "n_regionkey IN (1, 3)")
_add("where_string", "lineitem", lambda df: A.count(df.filter(C("l_returnflag") == "R")), "SELECT count(*) AS value FROM lineitem WHERE l_returnflag = 'R'")
_filter("where_match", "part", ["p_partkey"], lambda: T.matches_query("p_name", "BOL"), "contains(lower(p_name), 'bol')")
_filter("where_selection", "events", ["event_id"], lambda: T.in_selection(C("event_type"), "click, error"), "event_type IN ('click', 'error')")
_filter("where_modulo", "orders", ["o_orderkey"], lambda: C("o_totalprice").cast("double") % 3 < 0.5, "o_totalprice % 3 < 0.5")
_filter("has", "events", ["event_id"], lambda: J.has_key("props", "k"), "list_contains(json_keys(props), 'k')")
_filter("json_where", "events", ["event_id"], lambda: J.at("props", "k", kind="double") > 50, "CAST(props->>'k' AS DOUBLE) > 50")
_filter("non_null", "events", ["event_id"], lambda: ~F.coalesce(F.is_variant_null(J.parsed("props")), F.lit(False)), "json_type(props) <> 'NULL'")

# ---------------------------------------------------------------- fields and edits
_add("field_tally", "events", lambda df: A.tally(df, "event_type"), "SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1")
_map("field_column", "part", "p_partkey", lambda: T.field_at("p_name", 2), "coalesce(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '')[2], '')")
_map("fields", "part", "p_partkey", lambda: T.fields_at("p_name", 2, 1), "coalesce(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '')[2], '') || ' ' || coalesce(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '')[1], '')")
_map("cut", "customer", "c_custkey", lambda: T.cut("c_name", "#", 2), "split_part(c_name, '#', 2)")
_map("extract", "pages", "page_id", lambda: T.extract("url", "https?://([^/]+)", 1), "regexp_extract(url, 'https?://([^/]+)', 1)")
_map("substr", "customer", "c_custkey", lambda: T.substr("c_name", 3, 12), "substring(c_name, 4, 9)")
_map("json_field", "events", "event_id", lambda: J.at("props", "k"), "props->>'k'")
_map("pick", "events", "event_id", lambda: J.pick_keys("props", "k", "absent"), "'{\"k\":' || (props->>'k') || '}'")
_map("set", "events", "event_id", lambda: J.set_key("props", "a", "z"), "'{\"a\":\"z\",\"k\":' || (props->>'k') || '}'")
_map("del", "events", "event_id", lambda: J.del_key("props", "k"), "'{}'")
_map("rename", "events", "event_id", lambda: J.rename_key("props", "k", "kk"), "'{\"kk\":' || (props->>'k') || '}'")
_map("default", "events", "event_id", lambda: J.default_key("props", "z", "0"), "'{\"k\":' || (props->>'k') || ',\"z\":\"0\"}'")
_map("json_length", "events", "event_id", lambda: J.json_length("props"), "CAST(len(json_keys(props)) AS DOUBLE)")
_map("json_keys_array", "events", "event_id", lambda: F.to_json(J.keys("props")), "'[\"k\"]'")
_add("json_keys", "events", lambda df: R.keys(df.select("event_id", "props"), "props", ["event_id"]).select("event_id", C("value").alias("key")), "SELECT event_id, unnest(json_keys(props)) AS key FROM events")
_add("json_values", "events", lambda df: R.each(df.select("event_id", "props"), "props", ["event_id"]).select("event_id", "value"), "SELECT event_id, props->>'k' AS value FROM events")
_add("json_entries", "events", lambda df: R.entries(df.select("event_id", "props"), "props", ["event_id"]).select("event_id", "value"), "SELECT event_id, '{\"key\":\"k\",\"value\":' || (props->>'k') || '}' AS value FROM events")
_add("json_merge", "events", lambda df: A.merge(df, J.as_map("props"), ["event_id"]), "SELECT 'k' AS key, arg_max(props->>'k', event_id) AS value FROM events")
_map("json_path_sum", "events", "event_id", lambda: J.at("props", "k", kind="double") * 2 + 1, "CAST(props->>'k' AS DOUBLE) * 2 + 1")

# ---------------------------------------------------------------- several rows of one
_add("words_tally", "documents", lambda df: A.tally(R.words(df, "text", []).select(F.lower("value").alias("value")), "value"), "SELECT lower(w) AS key, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
_add("split", "customer", lambda df: R.split(df, "c_name", "#", ["c_custkey"]), "SELECT c_custkey, CAST(unnest(range(0, len(string_split(c_name, '#')))) AS INTEGER) AS sub, unnest(string_split(c_name, '#')) AS value FROM customer")
_add("chars", "nation", lambda df: A.tally(R.chars(df, "n_name", []), "value"), "SELECT c AS key, count(*) AS count FROM (SELECT unnest(string_split(n_name, '')) AS c FROM nation) GROUP BY 1")
_add("lines_each", "documents", lambda df: A.count(R.split(df, "text", "\n", [])), "SELECT count(*) AS value FROM (SELECT unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL)")
_add("array_flatten", "embeddings", lambda df: A.reduce(df.select(F.explode("embedding").alias("x")), "max", "x"), "SELECT max(CAST(x AS DOUBLE)) AS value FROM (SELECT unnest(embedding) AS x FROM embeddings)")
_map("array_length", "embeddings", "vec_id", lambda: F.size("embedding").cast("bigint"), "len(embedding)")
_map("array_slice", "embeddings", "vec_id", lambda: F.get("embedding", F.lit(0)).cast("double"), "CAST(embedding[1] AS DOUBLE)")

# ---------------------------------------------------------------- one value of one
_map("map_expr", "lineitem", "l_orderkey", lambda: C("l_extendedprice") * (1 - C("l_discount")), "l_extendedprice * (1 - l_discount)")
_map("map_ternary", "customer", "c_custkey", lambda: F.when(C("c_acctbal") != 0, T.divide(F.lit(100.0), C("c_acctbal"))).otherwise(0.0), "CASE WHEN c_acctbal <> 0 THEN 100 / c_acctbal ELSE 0 END")
_map("upper", "nation", "n_nationkey", lambda: F.upper("n_name"), "upper(n_name)")
_map("lower", "nation", "n_nationkey", lambda: F.lower("n_name"), "lower(n_name)")
_map("trim", "part", "p_partkey", lambda: T.utrim(F.concat(F.lit(" \t"), C("p_name"), F.lit(" \n"))), "p_name")
_map("title", "part", "p_partkey", lambda: T.title("p_name"), "array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> ''), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")
_map("replace", "part", "p_partkey", lambda: F.regexp_replace("p_type", r"([A-Z])([a-z]+)", "$2$1"), "regexp_replace(p_type, '([A-Z])([a-z]+)', '\\2\\1', 'g')")
_map("prepend", "nation", "n_nationkey", lambda: F.concat(F.lit("> "), C("n_name")), "'> ' || n_name")
_map("append", "nation", "n_nationkey", lambda: F.concat(C("n_name"), F.lit("!")), "n_name || '!'")
_map("pad", "nation", "n_nationkey", lambda: T.pad("n_name", 9), "CASE WHEN length(n_name) < 9 THEN rpad(n_name, 9, ' ') ELSE n_name END")
_map("lpad", "nation", "n_nationkey", lambda: T.lpad("n_name", 9), "CASE WHEN length(n_name) < 9 THEN lpad(n_name, 9, ' ') ELSE n_name END")
_map("repeat", "nation", "n_nationkey", lambda: F.repeat("n_name", F.lit(3)), "repeat(n_name, 3)")
_map("flip", "nation", "n_nationkey", lambda: F.reverse("n_name"), "reverse(n_name)")
_map("basename", "pages", "page_id", lambda: T.basename("url"), "regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$')")
_map("dirname", "pages", "page_id", lambda: T.dirname("url"), "regexp_extract(regexp_replace(url, '/+$', ''), '^(.*)/[^/]*$', 1)")
_map("len", "documents", "doc_id", lambda: F.length("text").cast("bigint"), "length(text)")
_map("wc", "documents", "doc_id", lambda: F.size(T.words("text")).cast("bigint"), "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))")
_map("abs", "customer", "c_custkey", lambda: F.abs("c_acctbal"), "abs(c_acctbal)")
_map("round", "customer", "c_custkey", lambda: F.round("c_acctbal"), "round(c_acctbal)")
_map("floor", "customer", "c_custkey", lambda: F.floor("c_acctbal").cast("double"), "CAST(floor(c_acctbal) AS DOUBLE)")
_map("ceil", "customer", "c_custkey", lambda: F.ceil("c_acctbal").cast("double"), "CAST(ceil(c_acctbal) AS DOUBLE)")
_map("clamp", "customer", "c_custkey", lambda: T.clamp(C("c_acctbal"), 0, 1000), "least(greatest(c_acctbal, 0.0), 1000.0)")
_map("commafy", "orders", "o_orderkey", lambda: T.commafy(F.floor("o_totalprice").cast("string")), "format('{:,}', CAST(floor(o_totalprice) AS BIGINT))")
_map("bytes", "orders", "o_orderkey", lambda: T.human_bytes(F.floor("o_totalprice").cast("string")), "CASE WHEN floor(o_totalprice) < 1024 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' B' ELSE regexp_replace(CAST(round(floor(o_totalprice) / 1024, 1) AS VARCHAR), '\\.0$', '') || ' KB' END")
_map("duration", "orders", "o_orderkey", lambda: T.human_duration((C("o_totalprice") % 86400).cast("string")), None)
_map("b64", "nation", "n_nationkey", lambda: T.b64("n_name"), "to_base64(encode(n_name))")
_map("b64d", "nation", "n_nationkey", lambda: T.b64d(T.b64("n_name")), "n_name")
_map("hex", "nation", "n_nationkey", lambda: T.hexed("n_name"), "lower(hex(encode(n_name)))")
_map("unhex", "nation", "n_nationkey", lambda: T.unhexed(T.hexed("n_name")), "n_name")
_map("urlenc", "pages", "page_id", lambda: T.urlenc("url"), "replace(replace(replace(replace(url_encode(url), '-', '%2D'), '_', '%5F'), '.', '%2E'), '~', '%7E')")
_map("urldec", "pages", "page_id", lambda: T.urldec(T.urlenc("url")), "url")
_PARTS = ", ".join(f"CASE WHEN {e} > 0 THEN ({e}) || '{u}' END" for e, u in (("n // 86400", "d"), ("n % 86400 // 3600", "h"), ("n % 3600 // 60", "m"), ("n % 60", "s")))
QUERIES["duration"] = (
    QUERIES["duration"][0],
    f"SELECT o_orderkey, CASE WHEN n = 0 THEN '0s' ELSE array_to_string(list_filter([{_PARTS}], lambda x: x IS NOT NULL)[1:2], ' ') END AS value FROM (SELECT o_orderkey, CAST(floor(o_totalprice % 86400) AS BIGINT) AS n FROM orders)",
)

# ---------------------------------------------------------------- order
_ORDER = "row_number() OVER (ORDER BY o_orderkey)"


def _ordered(name: str, make: Callable[[DataFrame], DataFrame], condition: str) -> None:
    _add(name, "orders", lambda df: make(df.select("o_orderkey", "o_totalprice")), f"SELECT o_orderkey, o_totalprice FROM (SELECT *, {_ORDER} AS n, count(*) OVER () AS c FROM orders) WHERE {condition}")


_K = ["o_orderkey"]
_ordered("sort_take", lambda df: df.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20), "o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)")
_ordered("take", lambda df: O.take(df, _K, 25), "n <= 25")
_ordered("drop", lambda df: O.drop(df, _K, 100), "n > 100")
_ordered("tailn", lambda df: O.tailn(df, _K, 25), "n > c - 25")
_ordered("first", lambda df: O.first(df, _K), "n = 1")
_ordered("last", lambda df: O.last(df, _K), "n = c")
_ordered("nth", lambda df: O.nth(df, _K, 0), "n = 1")
_ordered("index", lambda df: O.index(df, _K, 77), "n = 77")
_ordered("slice", lambda df: O.slice_rows(df, _K, 10, 400), "n BETWEEN 10 AND 400")
_ordered("sample_every", lambda df: O.every(df, _K, 7), "n % 7 = 0")
_ordered("rev", lambda df: O.reverse(df, _K), "true")
_ordered("sort_by", lambda df: df.orderBy("o_totalprice", "o_orderkey"), "true")
_add("enumerate", "orders", lambda df: O.numbered(df, _K, "n").select("o_orderkey", C("n").cast("bigint").alias("n")), f"SELECT o_orderkey, {_ORDER} AS n FROM orders")
_add("uniq", "orders", lambda df: O.unique_by(df.select("o_orderpriority", "o_orderkey"), _K, "o_orderpriority"), "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
_add("unique_by", "events", lambda df: O.unique_by(df.select("user_id", "event_id", "event_type"), ["event_id"], "user_id"), "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
_add("dedup", "orders", lambda df: O.dedup(df.select("o_orderkey", "o_orderpriority"), _K, "o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM (SELECT *, lag(o_orderpriority) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE p IS DISTINCT FROM o_orderpriority")
_add("dedup_roles", "conversations", lambda df: O.dedup(df.select("conv_id", "turn", "role"), ["conv_id", "turn"], "role"), "SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (ORDER BY conv_id, turn) AS p FROM conversations) WHERE p IS DISTINCT FROM role")
_add("join_lines", "region", lambda df: A.join_lines(df, "r_name", ["r_regionkey"], ", "), "SELECT string_agg(r_name, ', ' ORDER BY r_regionkey) AS value FROM region")

# ---------------------------------------------------------------- aggregates
_add("count", "lineitem", A.count, "SELECT count(*) AS value FROM lineitem")
_add("rate", "events", lambda df: A.rate(df, 60), "SELECT count(*) / 60.0::DOUBLE AS value FROM events")
_add("calc", "orders", lambda df: A.calc(df, lambda x: T.divide(x, F.lit(2.0))), "SELECT count(*) / 2.0::DOUBLE AS value FROM orders")
_add("count_by", "lineitem", lambda df: A.count_by(df, "l_returnflag"), "SELECT l_returnflag AS key, count(*) AS count FROM lineitem GROUP BY 1")
_add("group_by", "events", lambda df: A.group_by(df, "event_type", "event_id", ["event_id"]), "SELECT event_type AS key, list(event_id ORDER BY event_id) AS members FROM events GROUP BY 1")
for _name, _sql in {"sum": "round(sum(l_quantity), 2)", "min": "min(l_quantity)", "max": "max(l_quantity)", "range": "max(l_quantity) - min(l_quantity)"}.items():
    _add(f"reduce_{_name}", "lineitem", lambda df, n=_name: A.reduce(df, n, "l_quantity").select(F.round("value", 2).alias("value")), f"SELECT {_sql} AS value FROM lineitem")
for _name, _sql in {"avg": "avg(o_totalprice)", "stddev": "stddev_pop(o_totalprice)", "median": "quantile_cont(o_totalprice, 0.5)"}.items():
    _add(f"reduce_{_name}", "orders", lambda df, n=_name: A.reduce(df, n, "o_totalprice").select(F.round("value", 4).alias("value")), f"SELECT round({_sql}, 4) AS value FROM orders")
_add("reduce_product", "nation", lambda df: A.reduce(df, "product", C("n_regionkey") + 1), "SELECT product(n_regionkey + 1) AS value FROM nation")
_add("percentile_95", "events", lambda df: A.percentile(df, "value", 95), "SELECT quantile_cont(value, 0.95) AS value FROM events")
_add("distinct", "events", lambda df: A.distinct(df, "user_id"), "SELECT count(DISTINCT user_id) AS value FROM events")
_add("min_by", "orders", lambda df: A.min_by(df.select("o_orderkey", "o_totalprice"), "o_totalprice", _K), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
_add("max_by", "orders", lambda df: A.max_by(df.select("o_orderkey", "o_totalprice"), "o_totalprice", _K), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
_add(
    "bins", "events", lambda df: A.bins(df, "value", 10).select("bin", F.round("low", 6).alias("low"), "count"),
    "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CAST(i AS INTEGER) AS bin FROM range(10) t(i)), "
    "c AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1) "
    "SELECT b.bin, round(lo + b.bin * ((hi - lo) / 10), 6) AS low, coalesce(n, 0) AS count FROM b LEFT JOIN c USING (bin), e",
)

# ---------------------------------------------------------------- series
_E = ["ts", "event_id"]
_W = "OVER (ORDER BY ts, event_id"


def _series(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, "events", lambda df: make(df.select("ts", "event_id", "value")).select("event_id", F.round(name, 4).alias(name)), sql)


_series("delta", lambda df: O.delta(df, _E, "value"), f"SELECT event_id, round(d, 4) AS delta FROM (SELECT event_id, value - lag(value) {_W}) AS d FROM events) WHERE d IS NOT NULL")
_series("cumsum", lambda df: O.cumsum(df, _E, "value"), f"SELECT event_id, round(sum(value) {_W} ROWS UNBOUNDED PRECEDING), 4) AS cumsum FROM events")
_series("sma", lambda df: O.sma(df, _E, "value", 20), f"SELECT event_id, round(avg(value) {_W} ROWS 19 PRECEDING), 4) AS sma FROM events")
_add(
    "ewma", "events", lambda df: O.ewma(df.select("ts", "event_id", "value"), _E, "value", 0.5).select("event_id", F.round("ewma", 4).alias("ewma")),
    f"WITH n AS (SELECT event_id, value, row_number() {_W}) AS n FROM events), "
    "x AS (SELECT a.event_id, sum(b.value * CASE WHEN b.n = 1 THEN power(0.5, a.n - 1) ELSE power(0.5, a.n - b.n + 1) END) AS s FROM n a JOIN n b ON b.n <= a.n AND (b.n > a.n - 60) GROUP BY 1) SELECT event_id, round(s, 4) AS ewma FROM x",
)

# ---------------------------------------------------------------- records in lines, values of any type


def _event_line() -> Column:
    """A JSON line of several columns, nested, by event type one without value, one with a string, one that is no object."""
    whole = F.struct(C("event_id").alias("id"), C("event_type").alias("t"), C("value").alias("v"), F.struct(C("user_id").alias("u"), F.array("user_id", "event_id").alias("ids")).alias("n"))
    text = F.struct(C("event_id").alias("id"), C("event_type").alias("t"), F.concat(F.lit("s"), C("user_id")).alias("v"))
    return F.when(C("event_type") == "error", F.concat(F.lit("line "), C("event_id"))).when(C("event_type") == "view", F.to_json(text)).otherwise(F.to_json(whole))


_REST = "event_type NOT IN ('error', 'view')"
_add("record_grepf", "events", lambda df: RV.grepf(df.select("event_id", _event_line().alias("value")), "value", "v", "^s.*[13579]$").select("event_id"), "SELECT event_id FROM events WHERE event_type = 'view' AND user_id % 2 = 1")
_add("record_over", "events", lambda df: RV.over(df.select("event_id", _event_line().alias("value")), "value", 50, "v").select("event_id"), f"SELECT event_id FROM events WHERE {_REST} AND value > 50")
_add("record_under", "events", lambda df: RV.under(df.select("event_id", F.concat_ws(" ", "event_type", C("value").cast("string")).alias("value")), "value", 50, 2).select("event_id"), "SELECT event_id FROM events WHERE value < 50")
_add("record_between", "events", lambda df: RV.between(df.select("event_id", F.when(C("event_type") == "error", "none").otherwise(C("value").cast("string")).alias("value")), "value", 10, 60).select("event_id"), "SELECT event_id FROM events WHERE event_type <> 'error' AND value BETWEEN 10 AND 60")
_add("record_floor", "events", lambda df: RV.change_number(df.select("event_id", F.when(C("event_type") == "error", "1d").otherwise((-C("value")).cast("string")).alias("value")), "value", F.floor), "SELECT event_id, CASE WHEN event_type = 'error' THEN '1d' ELSE CAST(CAST(floor(-value) AS BIGINT) AS VARCHAR) END AS value FROM events")
_add(
    "record_sort_by", "events",
    lambda df: O.numbered(df.select("event_id", _event_line().alias("value")).select("event_id", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(RV.sort_keys("value", "v"))]).alias("k")), ["k", "event_id"], "n").select("event_id", C("n").cast("bigint").alias("n")),
    "SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 0 END, CASE WHEN event_type NOT IN ('error', 'view') THEN value END, CASE WHEN event_type = 'view' THEN 's' || user_id END, event_id) AS n FROM events",
)
_add("record_edits", "events", lambda df: df.select("event_id", J.set_key(J.rename_key(J.del_key(_event_line(), "v"), "t", "type"), "new", "z").alias("value")), "SELECT event_id, CASE WHEN event_type = 'error' THEN 'line ' || event_id WHEN event_type = 'view' THEN '{\"id\":' || event_id || ',\"new\":\"z\",\"type\":\"view\"}' ELSE '{\"id\":' || event_id || ',\"n\":{\"ids\":[' || user_id || ',' || event_id || '],\"u\":' || user_id || '},\"new\":\"z\",\"type\":\"' || event_type || '\"}' END AS value FROM events")
_add("record_keys", "events", lambda df: R.keys(df.select("event_id", _event_line().alias("value")), "value", ["event_id"]).select("event_id", C("value").alias("key")), f"SELECT event_id, unnest(CASE WHEN event_type = 'error' THEN ['line ' || event_id] WHEN {_REST} THEN ['id', 'n', 't', 'v'] ELSE ['id', 't', 'v'] END) AS key FROM events")
_map("record_default", "events", "event_id", lambda: J.has_key(J.default_key(_event_line(), "n", "none"), "n"), "event_type <> 'error'")
_map("value_plus", "orders", "o_orderkey", lambda: V.plus(F.to_json(F.struct(C("o_custkey").alias("a"), C("o_orderkey").alias("b"))), F.to_json(F.struct(C("o_orderstatus").alias("b")))), "'{\"a\":' || o_custkey || ',\"b\":\"' || o_orderstatus || '\"}'")
_map("value_plus_arrays", "orders", "o_orderkey", lambda: V.plus(F.to_json(F.array("o_orderkey", "o_custkey")), F.to_json(F.array("o_orderstatus"))), "'[' || o_orderkey || ',' || o_custkey || ',\"' || o_orderstatus || '\"]'")
_map("value_minus", "orders", "o_orderkey", lambda: V.minus(F.to_json(F.array("o_orderkey", F.lit(3), "o_custkey")), F.lit("[3.0]")), "CASE WHEN o_orderkey = 3 AND o_custkey = 3 THEN '[]' WHEN o_orderkey = 3 THEN '[' || o_custkey || ']' WHEN o_custkey = 3 THEN '[' || o_orderkey || ']' ELSE '[' || o_orderkey || ',' || o_custkey || ']' END")
_map("value_times", "orders", "o_orderkey", lambda: V.times(F.to_json(F.struct(C("o_orderstatus").alias("s"))).substr(6, 3), (C("o_custkey") % 4).cast("string")), "CASE WHEN o_custkey % 4 = 0 THEN 'null' ELSE '\"' || repeat(o_orderstatus, CAST(o_custkey % 4 AS BIGINT)) || '\"' END")
_map("value_over", "orders", "o_orderkey", lambda: V.over(F.concat(F.lit('"'), C("o_orderpriority"), F.lit('"')), F.lit('"-"')), "'[\"' || replace(o_orderpriority, '-', '\",\"') || '\"]'")
_map("value_modulo", "orders", "o_orderkey", lambda: V.modulo((-C("o_totalprice")).cast("decimal(20,2)").cast("string"), F.lit("7.9")), "CAST(-(CAST(floor(o_totalprice) AS BIGINT) % 7) AS VARCHAR)")
_add("value_failed", "events", lambda df: df.select("event_id", V.failed(V.plus(J.at(_event_line(), "v"), F.lit("1")), J.at(_event_line(), "v")).alias("value")), "SELECT event_id, event_type = 'view' AS value FROM events")
_add("value_truthy", "events", lambda df: A.count(df.filter(V.truthy(F.when(C("event_id") % 3 == 0, "null").when(C("event_id") % 3 == 1, "false").otherwise(C("value").cast("string"))))), "SELECT count(*) AS value FROM events WHERE event_id % 3 = 2")
_add(
    "value_order", "events",
    lambda df: O.numbered(df.select("event_id", V.order_key(F.when(C("event_id") % 5 == 0, F.to_json(F.array("user_id"))).when(C("event_id") % 5 == 1, "null").when(C("event_id") % 5 == 2, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(C("event_id") % 5 == 3, "true").otherwise(C("user_id").cast("string"))).alias("k")), ["k", "event_id"], "n").select("event_id", C("n").cast("bigint").alias("n")),
    "SELECT event_id, row_number() OVER (ORDER BY CASE event_id % 5 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 2 THEN 3 ELSE 4 END, "
    "CASE WHEN event_id % 5 IN (0, 4) THEN user_id END, CASE WHEN event_id % 5 = 2 THEN event_type END, event_id) AS n FROM events",
)
_map("value_entries", "nation", "n_nationkey", lambda: V.to_entries(F.to_json(F.struct(C("n_name").alias("n"), C("n_regionkey").alias("r")))), "'[{\"key\":\"n\",\"value\":\"' || n_name || '\"},{\"key\":\"r\",\"value\":' || n_regionkey || '}]'")
_map("value_mapped", "orders", "o_orderkey", lambda: V.mapped(F.to_json(F.array("o_orderkey", "o_custkey")), lambda e: V.times(e, F.lit("2"))), "'[' || o_orderkey * 2 || ',' || o_custkey * 2 || ']'")
_add("lines_numbered", "documents", lambda df: O.numbered(R.split(df, "text", "\n", ["doc_id"]), ["doc_id", "sub"], "n").select("doc_id", "sub", C("n").cast("bigint").alias("n")), "SELECT doc_id, sub, row_number() OVER (ORDER BY doc_id, sub) AS n FROM (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS sub FROM documents WHERE text IS NOT NULL)")
_add("slice_by_name", "customer", lambda df: O.slice_rows(df.select("c_mktsegment", "c_custkey"), ["c_mktsegment", "c_custkey"], 20, 90), "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 71 OFFSET 19")

# ---------------------------------------------------------------- formats, HTML, fuzzy search, streams


def _logfmt_line() -> Column:
    return F.concat(F.lit("id="), C("o_orderkey").cast("string"), F.lit(' status="'), C("o_orderstatus"), F.lit(' x" prio='), C("o_orderpriority"))


_map("logfmt_field", "orders", "o_orderkey", lambda: L.logfmt(_logfmt_line(), "status"), "o_orderstatus || ' x'")
_map("csv_field", "customer", "c_custkey", lambda: F.from_csv(F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), C("c_name"), F.lit(', x"')), "c_mktsegment"), "a STRING, b STRING, c STRING").getField("b"), "c_name || ', x'")
_add("toml_documents", "nation", lambda df: L.toml(df.select("n_nationkey", F.concat(F.lit("[n]\nname = '"), C("n_name"), F.lit("'\nkey = "), C("n_nationkey").cast("string")).alias("value"))), "SELECT n_nationkey, CAST(0 AS INTEGER) AS sub, '{\"n\":{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}}' AS value FROM nation")
_add("html_links", "pages", lambda df: H.select(df, "page_id", "html", "nav a", attribute="href"), "SELECT page_id, CAST(unnest(range(0, len(x))) AS INTEGER) AS sub, unnest(x) AS value FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), 'href=\"([^\"]*)\"', 1) AS x FROM pages)")
_add("html_titles", "pages", lambda df: H.select(df, "page_id", "html", "head > title"), None)
_add("html_paragraphs", "pages", lambda df: A.tally(H.select(df, "page_id", "html", "article p", own=True).select(F.length("value").cast("bigint").alias("n")), "n"), None)
_add("fuzzy_search", "part", lambda df: Z.search(df.select("p_partkey", "p_name"), "p_name", "gr an | 'blu !red", ["p_partkey"]), None)
_add("fuzzy_exact", "part", lambda df: Z.search(df.select("p_partkey", "p_name"), "p_name", "!red !blue", ["p_partkey"]).select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'blue')")
_map("via_pure", "events", "event_id", lambda: C("value") * C("value"), "value * value")
QUERIES["stream_filter"] = (
    lambda spark, sf_dir: S.run_append(S.table_stream(spark, sf_dir, "events"), lambda df: df.filter(C("event_type") == "error").select("event_id", J.at("props", "k").alias("k"))),
    "SELECT event_id, props->>'k' AS k FROM events WHERE event_type = 'error'",
)
QUERIES["stream_tally"] = (lambda spark, sf_dir: S.tally(S.table_stream(spark, sf_dir, "events"), "event_type"), "SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1")
QUERIES["stream_windows"] = (
    lambda spark, sf_dir: S.windowed_counts(S.table_stream(spark, sf_dir, "events"), "ts", "1 day", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "key", "count"),
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS key, count(*) AS count FROM events GROUP BY 1, 2",
)
QUERIES["stream_retain"] = (
    lambda spark, sf_dir: S.retain_last(S.table_stream(spark, sf_dir, "events"), "event_type", "value", "event_id", 10).select("key", "order", "value"),
    "SELECT event_type AS key, event_id AS \"order\", value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10",
)
_map("fmt_num", "orders", "o_orderkey", lambda: T.fmt_num("o_totalprice"), "CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END")
_map("json_slice", "embeddings", "vec_id", lambda: J.array_slice(F.to_json(F.transform("embedding", lambda v: F.lit(1) + F.floor(F.abs(v)))), 1, 3), "'[' || CAST(1 + CAST(floor(abs(embedding[2])) AS BIGINT) AS VARCHAR) || ',' || CAST(1 + CAST(floor(abs(embedding[3])) AS BIGINT) AS VARCHAR) || ']'")
_map("json_add", "lineitem", "l_orderkey", lambda: J.array_add(F.to_json(F.array("l_orderkey", "l_partkey", "l_linenumber"))), "CAST(l_orderkey + l_partkey + l_linenumber AS VARCHAR)")
_add("json_flatten", "nation", lambda df: R.explode_to(df.select("n_nationkey", F.concat(F.lit("["), C("n_nationkey").cast("string"), F.lit(",[[7],\"x\"]]")).alias("v")), J.leaves("v"), keep=["n_nationkey"]), "SELECT n_nationkey, CAST(unnest([0, 1, 2]) AS INTEGER) AS sub, unnest([CAST(n_nationkey AS VARCHAR), '7', '\"x\"']) AS value FROM nation")
_add("facet", "events", lambda df: A.facet(df, "user_id", ["event_id"]), "SELECT CAST(user_id AS VARCHAR) AS key FROM events GROUP BY user_id ORDER BY min(event_id) LIMIT 32")
_add("sparkline", "events", lambda df: A.sparkline(df, "value", ["event_id"], 60), None)
_add("sort_numeric", "part", lambda df: O.sort_lines(df.select("p_partkey", F.concat(C("p_size").cast("string"), F.lit(" "), C("p_name")).alias("line")), "line", ["p_partkey"], numeric=True, reverse=True), "SELECT p_partkey, CAST(p_size AS VARCHAR) || ' ' || p_name AS line FROM part ORDER BY p_size DESC, p_partkey DESC")
_add("html_outer", "pages", lambda df: H.select(df, "page_id", "html", "nav li a", outer=True).select("page_id", "sub", "value"), "SELECT page_id, CAST(unnest(range(0, len(x))) AS INTEGER) AS sub, unnest(x) AS value FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a .*?</a>') AS x FROM pages)")
