"""Corpus pipeline: from raw documents to packed training sequences.

STAGES lists (name, function) in order.  A function takes (spark, docs, sf_dir) and
returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents:

1. quality   documents that the classifier scores under its threshold go;
2. exact     of equal texts the largest doc_id stays;
3. near      one document of each SimHash component stays, its smallest doc_id;
4. mix       every document as often as the curriculum takes it, in training order, so a
             document may appear twice and the border document of a source is cut;
5. pack      tokenised, cut and packed: one row per piece.

ORACLE_SQL is None: SQL expresses neither the classifier nor SimHash; the stages are
tested against brute force instead.  Nulls, empty texts and tables, repeated rows and
clashing columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segcast.llm import dedup, mixing, packing, quality, simhash
from segcast.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good_documents(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
