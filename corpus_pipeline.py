"""Training-data pipeline: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm import bpe, mixing, pii, simhash, toxicity
from citeforge.llm.common import dropped_at_end, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores under the threshold."""
    scorer = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    rest = tuple(n for n in docs.columns if n not in ("doc_id", "text"))
    kept = toxicity.toxicity(docs, scorer, carry=rest, keep_text=True).where("predicted = 0")
    return kept.select(*[F.col(f"carry_{n}" if n in rest else n).alias(n) for n in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return simhash.one_of_each_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    names = docs.columns
    found = pii.pii(docs, carry=tuple(n for n in names if n not in ("doc_id", "text")))
    found = found.withColumn("text", F.when(F.col("spans") == "", F.col("text")).otherwise(F.col("redacted")))
    own = {n: F.col(f"carry_{n}") for n in names if n not in ("doc_id", "text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("spans") == "", own["n_chars"]).otherwise(F.length("text").cast("long"))
    return found.select(*[own.get(n, F.col(n)).alias(n) for n in names])


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document of the mix."""
    return bpe.bpe_encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mix_sources", mix_to_targets),
    ("byte_bpe", encode),
]

#: The language model, the CRF and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        dropped_at_end(spark, path)
        docs = spark.read.parquet(path)
    return docs
