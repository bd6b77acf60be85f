"""From raw documents to packed training sequences, in four stages.

toxicity: documents that the weakly supervised classifier (trained on the labelled rows) scores 0.5 or more go.
near_duplicates: one document of each group of copies (five-word shingles, similarity 0.8 or more) stays.
personal_data: e-mail addresses, IP addresses, card and phone numbers are masked in the text; n_chars follows.
packing: where each piece of each document goes among sequences of several permitted lengths (UTF-8 bytes).

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``, extra ones too.

toxicity: null and empty texts hold no term and stay; long texts are scored whole; repeated rows stay or go together.
near_duplicates: null and empty texts and texts without words are equal; one of them stays, the one of the least id (a null
id last); of rows that repeat an id and a text the one whose columns come first as JSON stays; long texts are compared whole.
personal_data: null texts stay null, empty ones empty; long texts are searched whole; repeated rows get equal texts.
packing: null and empty texts are pieces of length 0; long texts are cut into pieces; repeated rows are packed each;
equal lengths are taken in order of id. An empty table gives no rows in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanalign.llm import packing, pii, simhash, toxicity
from spanalign.llm.common import discard, read_table, shared_dir, small_batches
from spanalign.session import ship


def ready(spark: SparkSession) -> None:
    """Executors have the package, and texts go to their Python workers in small batches."""
    ship(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.drop_near_duplicates(docs, words_per_shingle=5, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    columns = docs.columns
    out = docs.withColumn("text", pii.masked(docs, pii.train(docs)))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: The classifier, the fingerprints and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's rows are written to the shared folder, read again, and
    deleted when the next stage's are written."""
    docs = read_table(spark, sf_dir, "documents")
    written: list[str] = []
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, written)  # the stage before is read no more
        written.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
