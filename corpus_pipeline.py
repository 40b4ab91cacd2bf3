"""From raw documents to packed token sequences, in five stages.

1. quality: documents that the ranking model rejects go.
2. exact: of equal texts the row with the largest doc_id stays.
3. near: of each group of near copies the document with the least doc_id stays. Near are fingerprints three bits or fewer
   apart (SimHash over three words, as op10), and texts whose sets of five-word shingles have a similarity of 0.8 or more.
4. substring: words of passages of 20 words or more that started earlier go. Texts without such passages stay as they
   are; of others, the words left are joined by one space. A text of which nothing is left stays as an empty one.
5. packing: sequences of 4096 tokens; its rows are the packed pieces.

Each stage but the last returns the columns of its documents, whatever they are besides doc_id and text; n_chars follows
the text where there is one. Null texts count as empty, and an empty table goes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.llm import common, exact_dedup, packing, quality, simhash, substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", keep_good), ("exact", drop_copies), ("near", drop_near_copies), ("substring", cut_repeats), ("packing", pack)]
#: Token ids and fingerprints can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written, and read again by the next."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
