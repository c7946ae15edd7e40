"""A corpus pipeline of four stages, each written as Parquet and read again as the next one's documents.

Stages work on all rows of ``docs``; the first three return the columns of ``documents`` (further columns of the
input are kept as well), the last one the places of packed pieces.

Defined results: a null text counts as empty, scores the classifier's bias and fails the base rules; null and repeated
ids are rows like others (of copies, the row of the smallest id stays, a null id last; of equal rows one); texts of any
length are used whole; a stage without rows returns none; columns of any other name, also ones that operators use
inside, pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import filters, packing, quality_classifier
from lodestone.llm.common import give_back, stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    give_back(spark)
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    give_back(spark)
    return filters.kept_by_rules(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest doc_id."""
    give_back(spark)
    return filters.one_of_each_class(docs)


#: Entries of the encoder's memos (pieces, words): workers that earlier stages have used stand beside a heap that they have filled.
MEMOS = (100_000, 100_000)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces' places in sequences of at most 4,096 tokens."""
    give_back(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), memos=MEMOS)
    return packing.pack(stored(pieces, "pieces"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("simhash_near_dedup", one_of_each), ("best_fit_packing", pack)]

#: SQL has neither the trained scores nor the tokens; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
