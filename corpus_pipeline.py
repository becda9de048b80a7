"""From documents to token ids: what each stage keeps is the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbox.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from lumenbox.llm.store import save, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic; it learns from the labels of documents that came. Null texts
    are scored as empty; rows that repeat a text share its fate; ids may be null; columns of any name go through."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return toxicity.score(whole, machine).where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id, null and empty texts being equal; a null id stays where no row of its
    text has an id."""
    return exact_dedup.drop_exact_duplicates(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more the one with the smallest doc_id; null ids stay,
    and rows that repeat an id go together."""
    classes = ngram_join.ngram_join(docs).select(F.col("doc_id").alias("__id"), "component_id").where("__id is not null and component_id <> __id").select("__id").distinct()
    return docs.join(classes, docs["doc_id"] == classes["__id"], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by its own id and source; a null source is one of its own."""
    return mixing.mixture(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix, repeated as it is; a null text has no ids."""
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_bytes),
]

#: A fitted score, a random draw and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each but the last written to the shared folder and read again. An empty table goes through all."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}-{uuid.uuid4().hex[:6]}")
    return STAGES[-1][1](spark, docs, sf_dir)
