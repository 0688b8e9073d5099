"""Corpus preparation: toxic documents out, near duplicates out, personal data
pseudonymised, sources mixed to their targets, texts encoded.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import bpe, common, mixing, ngram_join, pii, toxicity
from stockflow.llm.queries import tokenizer_path
from stockflow.session import checkpoint_dir

#: No stage but the first has a result that SQL can express; the tests hold each against a brute-force version.
ORACLE_SQL = None

#: Scratch folders of the last stage that was called. Its result has been
#: written by the time the next stage is called, so they can go then.
_last = (0, 0)


def _stage(work):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        common.sweep(spark, *_last)
        start = common.mark()
        out = work(spark, docs, sf_dir)
        _last = (start, common.mark())
        return out

    return run_stage


@_stage
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic (operator 6)."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix, taken = "p_", {c.lower() for c in docs.columns}
    while {f"{prefix}{x}".lower() for x in chain.names} & taken:
        prefix = "_" + prefix
    scored = toxicity.score(docs, chain, keep=docs.columns, prefix=prefix)
    return scored.where(~toxicity.is_in(chain, "toxic", prefix)).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (operator 9): Jaccard
    similarity of 0.8 or more on shingles of five words."""
    return ngram_join.keep_one(docs, ngram_join.JoinSpec(k=5, percent=80))


@_stage
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within its format (operator 3)."""
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 2)."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (operator 1)."""
    ids = bpe.encode(docs, tokenizer_path(), keep=["doc_id", "source", "lang"])
    return ids.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("source mix", source_mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
