"""A corpus pipeline out of the training-data operators.

``STAGES`` lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a table that is
written as Parquet and read again as the next stage's documents; all but the last return the columns of ``documents``.

Defined cases, for every stage: an empty table gives an empty one; nulls in lang, source and n_chars are data like any
other; further columns, whatever their names, are kept by all stages but the last. Nulls, empty texts, ties and
repeated rows stand with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import exact_dedup, ngram_join, packing, pii, quality
from weirflow.llm.common import read_table, scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted text is within their language's limit.

    Null texts and texts without words go. A perplexity equal to the limit stays; repeated rows get equal verdicts.
    Without labels there is no trusted text, and every document with a word stays.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    A null text is an empty one. Of repeated rows one stays; rows without an id go when a row with an id has their
    text, else one for each text stays.
    """
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id.

    Texts without words link with nothing and stay; texts of fewer than five words are one shingle; links are followed,
    so a group is a connected component; rows with a null id are not linked and stay.
    """
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; n_chars follows the text.

    All rows stay. A null text stays null and so is its n_chars; repeated rows give repeated results.
    """
    new = pii.redact(docs)
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their places in sequences of 4096 tokens.

    A null or empty text has one token; repeated rows have places of their own; further columns are left.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage is a trained model, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between them is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
