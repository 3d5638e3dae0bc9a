"""From raw documents to token ids: toxicity, near-duplicates, repeated passages, mixing, tokens.

Each stage is written as Parquet to the shared folder and read again as the next one's documents.
Stages read the columns of documents (doc_id, text, lang, source, n_chars) and ignore all others, so
others may have any name.  An empty table stays empty through every stage (tokens then returns no row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.minhash import near_duplicates
from rasterloom.llm.mixing import mix_sources
from rasterloom.llm.queries import read, training_labels
from rasterloom.llm.sentencepieces import encode_documents
from rasterloom.llm.store import Workspace
from rasterloom.llm.substring import remove_repeats
from rasterloom.llm.toxicity import score_toxicity

#: Documents scored at or over this are rejected.
TOXIC = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic.

    Every row is judged by its own whole text, however long, and goes if its score is TOXIC or more, with a
    null doc_id too; null and empty texts score the base rate of the labels (under TOXIC in any usual
    label set) and stay; repeated rows stay or go together; equal cosines go to the earlier example.
    """
    scored = score_toxicity(docs.select(*COLUMNS), training_labels(spark, sf_dir, "toxic"), carry=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") < TOXIC).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null, empty and white-space texts are in no group and stay, as do rows with a null doc_id; rows that
    repeat a doc_id are one document and stay or go together; long texts are compared whole.
    """
    copies = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without passages that documents of smaller ids have; untouched texts stay as they are.

    Of equal passages the smallest doc_id keeps its own; rows that repeat a doc_id do not cut each other, and
    rows with a null doc_id neither cut nor are cut; null texts stay null and empty ones empty; a text of
    which nothing is left stays as the empty text; n_chars follows where a text is cut.
    """
    out = remove_repeats(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"), whole=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source gets a share that goes with the root of its size.

    A null source is the source ''; null and empty texts weigh nothing and are repeated as others of their
    source, and a source of such texts alone is left out; a null doc_id counts as the empty string;
    repeated rows get equal counts; any rate that follows from the sizes holds.
    """
    return mix_sources(docs.select(*COLUMNS), power=0.5, rate=1.0, seed=1).drop("copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_ids, ids, round_trip.

    A null text has null ids and an empty one none; a null doc_id is carried along; repeated rows give
    repeated results; long texts are encoded whole.
    """
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("tokens", tokens)]

#: No SQL expresses the scoring and tokenising stages; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return docs
