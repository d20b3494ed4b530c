"""The corpus pipeline: language, near-duplicates, personal data, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``. Each stage works for any rows: null columns, empty and very
long texts, ties and repeated rows, empty tables and further columns (kept but for the last).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilldex.llm import bpe, chosenpath, langid, mixing, pii
from quilldex.llm.common import Work, held_out, ship, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no learnt language; a null lang becomes the predicted one."""
    ship(spark)
    return langid.keep_known(docs, langid.sample(docs.filter(~held_out(4, 2)), Work(spark, "language")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 over five-word shingles."""
    ship(spark)
    return chosenpath.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data by its kind; n_chars follows the text."""
    ship(spark)
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come near their targets."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and their digest for every row of the mixture."""
    ship(spark)
    encoded = bpe.encode_documents(docs, bpe.default_path())
    return encoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Suffix automata, set similarity and byte-pair merging are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves in the shared folder goes once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        known = [*Work.open]
        result = stage(spark, docs, sf_dir)
        work = Work(spark, f"pipeline-{name}")
        docs = work.keep(result, name)
        for old in [w for w in Work.open if w not in known and w is not work] + ([before] if before else []):
            old.close()
        before = work
    return docs
