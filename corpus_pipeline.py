"""From raw documents to packed sequences: language, near-duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, packing, pii, simhash
from tidemark.llm.common import scratch_table

#: Columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are in none of the languages learned from docs itself, NULL and letterless ones included."""
    models = langid.train(docs)
    return langid.predict(docs.select(*COLUMNS), models).where("not rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near fingerprints, the row with the smallest id, the first of several with that id.

    Rows are judged one by one: rows that repeat an id with another text are documents of their own, and so are
    rows with a NULL id, which stay only in groups without an id. The rows are numbered and written once, so that
    their numbers can't change while they are compared.
    """
    numbered = scratch_table(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row")
    groups = simhash.near_duplicates(numbered.select(row.alias("row"), "text"), id_col="row")
    stays = groups.where(F.col("row") == F.col("component_id")).select("row._row")
    # the numbers grow with the documents: never broadcast, so the join is the same at every size, and texts aren't sorted
    return numbered.join(stays.hint("shuffle_hash"), "_row", "left_semi").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages' models, hashes and tokenizer are beyond SQL; a test holds run() against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch_table(docs, name)
    return docs
