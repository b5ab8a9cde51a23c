"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, common, decontaminate, line_dedup, minhash, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    Null and empty texts are judged as empty ones, very long ones by all they hold;
    null ids have no label; repeated rows and ties with the threshold stay or go
    together; without labels all stay; an empty table stays empty.
    """
    return quality.accepted(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier one; a text of which nothing is left is empty.

    Null and empty texts stay, very long ones are joined whole; earlier is by
    (doc_id, hash of the text, line), a null id first; repeated rows are one document
    and stay; an empty table stays empty.
    """
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least (doc_id, hash of the text), a null id first.

    Of rows that are alike, one stays.  Null texts and those without words are never
    copies and stay, very long ones are sets like others; an empty table stays empty.
    """
    return minhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item of eight words or more.

    Null and empty texts and items overlap nothing, very long ones are read whole;
    ids make no difference; repeated rows stay or go together; an empty table stays
    empty, and an empty benchmark takes nothing.
    """
    return decontaminate.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens) of each document.

    A null text has nulls, an empty one no ids, a very long one those of the whole;
    null ids and repeated rows stay; an empty table gives none.
    """
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Boosted trees and byte-pair merges are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
