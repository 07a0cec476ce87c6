"""A corpus pipeline over ``documents``: each stage calls one operator of ``tablestats.llm``.

A stage is a function of (spark, docs, sf_dir); its rows are written as Parquet in
the shared folder and read again as the next stage's docs. All stages but the
last return the columns of ``documents``; the last returns one row per document
of the mix, as often as the mix takes it, with the digests of its ids.

``n_chars`` is the length of the text, so the stage that changes texts renews it.

Edge cases, by stage: see each one. For all: rows are rows, so repeated rows count each
until near-dedup leaves one; columns of any other name, also those that operators use inside, pass
through unchanged up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablestats.llm import bpe, line_dedup, mixing, quality, simhash
from tablestats.llm.common import table, work_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text scores as an empty one; rows without an id are scored, their labels unknown;
    without labels of both kinds nothing is rejected.
    """
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines over the boilerplate ratio of their source go; documents stay.

    A null text stays null (and so does its ``n_chars``), a text that loses all lines stays as an empty one;
    rows without a source are a source of their own.
    """
    out = line_dedup.drop_boilerplate(docs, "source", "text")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Texts without words, null ones included, are one group; the smallest id of a group stays, a row
    without an id only where the group has none (see ``simhash.keep_representatives``).
    """
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A text without words has size 0: it is repeated as its whole source is, and never fills a rest.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix; a null text has no tokens."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding", encode),
]

#: SQL has no dictionary compression, SimHash components or BPE merges: the
#: stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
