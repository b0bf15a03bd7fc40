"""Corpus pipeline: quality classifier, near-duplicate removal, source mixing, packing.

Each stage works on all that the one before kept. run() writes every stage's result to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import minhash, mixing, packing, quality
from stockweave.llm.graph import rows_in, rows_not_in
from stockweave.llm.queries import END_ID
from stockweave.llm.tokens import default_tokenizer
from stockweave.session import materialize


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group. Rows that repeat its id and text become one, the one
    whose columns hash lowest; other texts under its id stay, as do rows without an id."""
    found = materialize(minhash.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "copies")
    kept = rows_not_in(docs, found)
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row_")
    once = rows_in(kept, repeated).groupBy("doc_id", F.md5("text").alias("digest_")).agg(row).select("row_.*")
    return rows_not_in(kept, repeated).unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix: a row for each whole repeat, the first words of a cut one."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as op4 gives them."""
    pieces = packing.pack(docs, default_tokenizer(), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("quality", keep_good_quality), ("near_duplicates", keep_one_of_each_group), ("mix", mix_sources), ("pack", pack_sequences)]

#: SQL cannot state a learnt classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
