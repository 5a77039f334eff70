"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage returns the columns of ``documents``, the last one the packed pieces. Between stages the rows are
written as Parquet in the shared folder and read again.

Defined cases: a null, empty or letterless text has no language and goes in the first stage; of rows that repeat an id, and of
equal texts without an id, one stays; texts without an id are else kept, lose nothing and are packed; very long texts are kept
whole; an empty table gives no piece; further columns are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import jaccard, language, packing, substring, winnow
from touchline.llm.queries import VOCABULARY
from touchline.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter have no language and go; ``lang`` becomes the prediction."""
    train = docs.filter(~language.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    model = language.fit(train, language.known_labels(train))
    said = language.predict(docs, model, list(COLUMNS)).filter(F.col("lang_pred") != language.UNKNOWN)
    return said.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group; of rows that repeat an id, or a text without one, the one of the first text."""
    groups = jaccard.jaccard_components(docs)
    others = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    # a null id is known by its text
    keyed = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))))
    again = stage(keyed.groupBy("key").count().filter("count > 1").select("key"))
    kept = keyed.join(others, "doc_id", "left_anti")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    first = kept.join(again, "key").groupBy("key").agg(F.min(F.struct("text", *[c for c in COLUMNS if c != "text"])).alias("row"))
    return kept.join(again, "key", "left_anti").select(*COLUMNS).unionByName(first.select("row.*").select(*COLUMNS))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the text; a document of which nothing is left goes with them."""
    out = substring.deduplicated(docs.select(*COLUMNS)).filter("n_removed < n_words or n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty is a test item's go."""
    found = winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.filter(winnow.contaminated()).select("rk").distinct()
    return docs.withColumn("rk", winnow.row_key("doc_id", "text")).join(hit, "rk", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot tokenize by the vocabulary; ``run`` is held against a plain version in tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
