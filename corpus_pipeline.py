"""Corpus pipeline over ``documents``: five stages, each written and read again before the next.

Toxic documents go; of near-duplicates one stays; personal data is replaced by its kind; sources are mixed to square-root
weights; texts become SentencePiece ids. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.llm import jaccard, mixing, pii, sentencepiece, toxicity
from tabletext.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    Null and empty texts are scored like texts without words and stay; repeated rows and rows with null ids are judged each by
    its own text; columns beside those of documents are dropped; no rows give no rows.
    """
    model, _ = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id", 5, 0))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Of repeated rows one stays; a null id comes last in its group; null and empty texts are in no group and all stay; very
    long texts are compared whole.
    """
    return jaccard.keep_first(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind.

    A null text stays null with a null length, an empty one stays empty; repeated rows are redacted alike; ids may be null.
    """
    found = pii.find_pii(docs, redact=True)
    text = F.when(F.col("text").isNotNull(), F.col("redacted"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order.

    Null is a source of its own; repeated rows draw alike by id; texts may be null or empty; no rows give no rows.
    """
    return mixing.mix_sources(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it.

    A null text has null ids, a null count, and comes back as null; an empty one has no ids; repeats are encoded alike.
    """
    coded = sentencepiece.encode(docs.select("doc_id", "source", "lang", "text"), decoded="decoded")
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", clean),
    ("n-gram Jaccard join", deduplicate),
    ("PII", redact),
    ("mixing sources", mix),
    ("SentencePiece", tokenize),
]

#: The classifier and the random field have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
