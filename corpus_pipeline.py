"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

1. quality: the classifier's word vectors cover the stage's whole input; documents that score below 0.3 go.
2. near_dedup: of each group of documents that links of similarity 0.8 or more connect (five-word shingles, candidates by SimHash anchors, every link
   verified) one stays, the one with the least doc_id.
3. decontaminate: contaminated documents go; in others, words in benchmark windows are cut.
4. secrets: secrets are masked in the text; no document goes.
5. mix: sources weigh 5, 2, 1, repeating; the documents taken stay, with the number of copies.

Defined edge cases, by stage.  Texts that are null, empty or blank: share one score, and stay or go together (1); are one group, of which one row
stays (2); are never contaminated and hold no secret, and come through unchanged (3, 4); have no words, and are not taken (5).  Repeated rows: stay or
go together (1); one stays (2); are treated alike (3, 4, 5).  Null ids: cannot be learned from (1); come last, so of a group with an id such a row goes (2).
Null sources are a source of their own (5).  Rows of one id with different texts are different documents.  Very long texts are treated whole.  Nulls in
other columns, and extra columns, come through; ``copies`` gives way in (5), and n_chars follows a changed text (3, 4).  Empty tables give empty tables.

Scores, XXH64 fingerprints and components cannot be expressed in SQL, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.checkpoints import stored
from haplospark.llm import decontaminate as decontamination
from haplospark.llm import mix as mixing
from haplospark.llm import quality as classifier
from haplospark.llm import secrets_scan, simhash
from haplospark.llm.common import table
from haplospark.llm.queries import mix_weights


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, F.array("source"), mix_weights)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", docs)
    return docs
