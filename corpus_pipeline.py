"""From documents to packed training sequences: five stages, each of which works on all that the one ahead has kept.

1. quality: documents that the n-gram model of trusted text finds too unlikely for their language go.
2. near_duplicates: of each group of near duplicates one document stays.
3. surrogates: personal data is replaced.
4. mix: sources are mixed to their target weights; documents repeat or drop out.
5. pack: the mix is tokenised and packed into sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, the last one its pieces.
Defined results for nulls, empty texts, repeated rows and empty tables are those of the operators.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, mixing, packing, perplexity, pii
from tessera.llm.shared import surrogate_key, table


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return perplexity.keep(docs, perplexity.judge(docs, trusted))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, jaccard_join.groups(docs))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(pii.replace(docs, surrogate_key(spark)).select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(mixing.mixed_documents(docs, mixing.mix(mixing.sized(docs))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("surrogates", surrogates), ("mix", mix), ("pack", pack)]

#: SQL cannot express the model, the join's groups, the surrogates and the packing: the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder that spark.checkpoint.dir names, and read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
