"""The queries of these operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chosenpath, hnsw, langid, matroska, mixing, pii, toxicity, urlfilter, warc
from .common import Work, held_out, ship, table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    archive = warc.write_archive(table(spark, sf_dir, "pages"), Work(spark, "warc"))
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, out = table(spark, sf_dir, "documents"), held_out(3, 1)
    model = toxicity.train(docs.filter(~out), table(spark, sf_dir, "labels").filter(~out), Work(spark, "toxicity"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.digest(pii.extract(table(spark, sf_dir, "documents")))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return matroska.describe(matroska.store(matroska.to_media(table(spark, sf_dir, "documents")), Work(spark, "media")))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, out = table(spark, sf_dir, "documents"), held_out(4, 2)
    samples = langid.sample(docs.filter(~out), Work(spark, "language"))
    return langid.predict(docs, samples).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digest(bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.default_path()))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_warc, op3_toxicity, op4_urls, op5_pii, op6_matroska, op7_vectors, op8_near, op9_language, op10_bpe, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": mixing.ORACLE, "op2_warc": warc.ORACLE, "op4_urls": urlfilter.oracle(), "op7_vectors": hnsw.ORACLE, "op8_near": chosenpath.ORACLE}
