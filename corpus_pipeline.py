"""From raw documents to packed training sequences.

Every stage works on all rows its predecessor kept and returns them with the columns of ``documents``; the last returns
pieces of sequences. Null and empty texts have no language and go in the first stage. Rows may repeat or lack an id: equal rows are copies, of
which one stays. Texts are taken whole, however long. An empty table gives no pieces. Columns besides those of ``documents`` pass through all stages but the last,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shiftledger.llm import dedup, jaccard, langid, packing, pii
from shiftledger.llm.common import table, written


_ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _for_long_rows(spark: SparkSession) -> None:
    """Documents are long rows: fewer of them than Spark's 10,000 go to a Python worker at once, unless the session says how many."""
    if spark.conf.get(_ROWS_AT_ONCE, None) is None:
        spark.conf.set(_ROWS_AT_ONCE, "1024")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a determined language; learns from the labelled rows among them."""
    _for_long_rows(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest stays."""
    _for_long_rows(spark)
    found = dedup.dedup(docs, carry=tuple(docs.columns))
    return found.where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.75 join, the one with the smallest id stays."""
    _for_long_rows(spark)
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; every document stays."""
    _for_long_rows(spark)
    return pii.masked(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences in which every source has its share."""
    _for_long_rows(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("packing", sequences),
]
#: Language ID, span masks and tokens are beyond SQL; tests compare the pipeline with a plain walk.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
