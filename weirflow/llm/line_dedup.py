"""Line dedup by a log-template tree (operator 9), in DataFrame operations only.

The tree has a fixed depth: a line goes to the leaf named by its number of tokens and its first ``LEAD`` tokens, where
tokens with a digit count as the variable ``<*>``. Within a leaf a token at a position is constant when lines of at
least ``MIN_DOCS`` documents have it there, else it is variable too. A line's template is its leaf and its constant
tokens. Templates of at least ``MIN_DOCS`` documents and of constants in at least half of their positions recur; their
lines are dropped from every document. Lines of fewer than ``MIN_TOKENS`` tokens need constants in all positions.

Work is reduced step by step: leaves of too few documents go first, then lines are reduced to distinct ones with their
number of documents, so only those are taken apart into tokens. Lines, leaves and tokens that a third of all rows share
are joined by ``join_weighted`` and counted by partial sums.

Defined cases: null and empty texts have one empty line; blank lines are never dropped; repeated rows of one id count as one document and get equal verdicts; further columns are kept by ``drop_recurring_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import join_weighted, materialize, read_table

LEAD = 3
MIN_TOKENS = 4
MIN_DOCS = 5
MIN_CONSTANT = 0.5
VARIABLE = "<*>"


_GAP = " \\t\\r\\f\\x0B"
#: A token with a digit; the first part looks at starts of tokens only, so long tokens take linear time.
_NUMBERED = f"(?<![^{_GAP}\\n])[^{_GAP}\\n0-9]*+[0-9][^{_GAP}\\n]*+"


def digest(*columns) -> Column:
    """128 bits of MD5: lines, leaves and templates are told apart by these."""
    return F.unhex(F.md5(F.concat_ws("\n", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])))


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, body) of every line that is not blank; body has its tokens, variables masked."""
    text = F.coalesce(text_col, F.lit(""))
    wide = F.lit(False)
    for gap in ("  ", "\t", "\r", "\f", "\x0b"):
        wide = wide | text.contains(gap)
    # most texts have single blanks only and most lines no digit: the patterns are for the others
    text = F.when(wide, F.regexp_replace(text, f"[{_GAP}]+", " ")).otherwise(text)
    masked = lambda line: F.trim(F.when(line.rlike("[0-9]"), F.regexp_replace(line, _NUMBERED, VARIABLE)).otherwise(line))
    bodies = F.transform(F.split(text, "\n"), masked)  # within the array, so that each is computed one time
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(bodies).alias("line_no", "body")).filter("body <> ''")


def tokens_in(body: str) -> Column:
    return F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit(""))) + 1


def documents_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_docs, n_rows): documents and rows that have a key."""
    return rows.groupBy(key, "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c").alias("n_rows"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no) of the lines to drop."""
    parsed = split_lines(docs, id_col, text_col)
    keyed = materialize(parsed.select("doc_id", "line_no", digest(tokens_in("body"), F.substring_index("body", " ", LEAD)).alias("leaf"), digest("body").alias("line"), "body"), "lines")
    leaves = materialize(documents_of(keyed, "leaf").filter(F.col("n_docs") >= MIN_DOCS), "leaves")
    shared = materialize(join_weighted(keyed, leaves, "leaf", "n_rows").select("doc_id", "line_no", "leaf", "line", "body"), "shared-lines")

    # distinct lines of those leaves, with their text once
    counted = materialize(documents_of(shared, "line"), "counted-lines")
    # the documents, fewer than MIN_DOCS, of the other lines: only of these can several together make a token constant
    rare = join_weighted(shared.select("doc_id", "line"), counted, "line", "n_rows").filter(F.col("n_docs") < MIN_DOCS)
    rare = rare.groupBy("line").agg(F.collect_set(F.xxhash64("doc_id")).alias("docs"))
    bodies = shared.groupBy("line", "leaf", "body").agg(F.count(F.lit(1)).alias("_c"))
    distinct = bodies.withColumn("n", tokens_in("body")).join(counted, "line").join(rare, "line", "left").drop("_c")
    distinct = materialize(distinct, "distinct-lines")

    # constants of each leaf: a line has the token in MIN_DOCS documents, or all lines with it have distinct ones enough
    token = distinct.select("line", "leaf", "n", "n_docs", "docs", F.posexplode(F.split("body", " ")).alias("place", "token"))
    token = token.withColumn("spot", digest(F.hex("leaf"), "place", "token"))
    support = token.select("spot", "n_docs", F.explode_outer("docs").alias("doc")).groupBy("spot", "doc").agg(F.max("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("c"))
    support = support.groupBy("spot").agg(F.greatest(F.max("n_docs"), F.count("doc")).alias("support"), F.sum("c").alias("n_spot"))
    marked = join_weighted(materialize(token.select("line", "n", "place", "token", "spot"), "tokens"), materialize(support, "support"), "spot", "n_spot")
    constant = (F.col("support") >= MIN_DOCS) & (F.col("token") != VARIABLE)
    pieces = marked.select("line", "n", F.struct("place", F.when(constant, F.col("token")).otherwise(VARIABLE).alias("t")).alias("piece"), constant.cast("int").alias("fixed"))
    lines = pieces.groupBy("line").agg(F.first("n").alias("n"), F.sum("fixed").alias("fixed"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    lines = lines.filter(F.col("fixed") >= F.when(F.col("n") < MIN_TOKENS, F.col("n")).otherwise(F.col("n") * MIN_CONSTANT))
    named = lines.select("line", digest(F.array_join(F.transform("pieces", lambda p: p["t"]), " ")).alias("template"))
    named = materialize(named.join(counted.select("line", "n_rows"), "line"), "templates")

    # templates by their documents
    placed = materialize(join_weighted(shared.select("doc_id", "line_no", "line"), named, "line", "n_rows").select("doc_id", "line_no", "template"), "placed")
    recurring = documents_of(placed, "template").filter(F.col("n_docs") >= MIN_DOCS)
    return join_weighted(placed, materialize(recurring, "recurring"), "template", "n_rows").select("doc_id", "line_no")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the lines of recurring templates taken out; adds dropped_lines, their numbers in order (in place of an input column of that name)."""
    dropped = recurring_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias("_dropped_id")).agg(F.array_sort(F.collect_set("line_no")).alias("_dropped_lines"))
    found = docs.drop("dropped_lines").join(dropped, F.col(id_col) == F.col("_dropped_id"), "left").drop("_dropped_id")
    found = found.withColumn("dropped_lines", F.coalesce("_dropped_lines", F.array().cast("array<int>"))).drop("_dropped_lines")
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
    kept = F.filter(lines, lambda line, k: ~F.array_contains("dropped_lines", k))
    return found.withColumn(text_col, F.when(F.size("dropped_lines") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id",
        F.size("dropped_lines").cast("bigint").alias("n_dropped"),
        F.array_join("dropped_lines", ",").alias("dropped_lines"),
        F.sha2(text, 256).alias("text_sha256"),
    )


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
parsed AS (
  SELECT doc_id, line_no, list_transform(list_filter(regexp_split_to_array(line, '[ \\t\\r\\f\\x0B]+'), lambda t: t <> ''),
         lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{VARIABLE}' ELSE t END) AS w FROM lines),
keyed AS (
  SELECT doc_id, line_no, len(w) AS n, w, len(w) || ' ' || array_to_string(w[1:{LEAD}], ' ') AS leaf, array_to_string(w, ' ') AS body
  FROM parsed WHERE len(w) > 0),
leaves AS (SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
tokens AS (
  SELECT doc_id, leaf, body, unnest(range(0, len(w))) AS place, unnest(w) AS token FROM keyed WHERE leaf IN (SELECT leaf FROM leaves)),
support AS (SELECT leaf, place, token, count(DISTINCT doc_id) AS s FROM tokens GROUP BY ALL),
distinct_tokens AS (SELECT DISTINCT leaf, body, place, token FROM tokens),
named AS (
  SELECT leaf, body, string_agg(CASE WHEN s >= {MIN_DOCS} THEN token ELSE '{VARIABLE}' END, ' ' ORDER BY place) AS template,
         count(*) FILTER (WHERE s >= {MIN_DOCS} AND token <> '{VARIABLE}') AS fixed, count(*) AS n
  FROM distinct_tokens JOIN support USING (leaf, place, token) GROUP BY leaf, body),
placed AS (
  SELECT doc_id, line_no, template FROM keyed JOIN named USING (leaf, body)
  WHERE fixed >= CASE WHEN named.n < {MIN_TOKENS} THEN named.n ELSE named.n * {MIN_CONSTANT} END),
dropped AS (
  SELECT DISTINCT doc_id, line_no FROM placed
  WHERE template IN (SELECT template FROM placed GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS})),
kept AS (
  SELECT l.doc_id, count(d.line_no) AS n_dropped, coalesce(string_agg(CAST(d.line_no AS VARCHAR), ',' ORDER BY d.line_no), '') AS dropped_lines,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE d.line_no IS NULL), '') AS text
  FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.line_no = d.line_no GROUP BY l.doc_id)
SELECT doc_id, n_dropped, dropped_lines, sha256(text) AS text_sha256 FROM kept
"""
