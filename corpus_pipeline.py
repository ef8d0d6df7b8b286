"""A corpus in five stages: quality, toxicity, boilerplate lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
Stages with Python workers lower the session's bounds on an Arrow batch (common.small_batches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm import line_dedup, packing, quality, simhash, toxicity
from fieldscope.llm.common import durable, small_batches, table, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a good grade is one half or more.

    Null and empty texts are scored as texts without words; rows that repeat are scored each; without labels of two grades all stay.
    """
    small_batches(spark)
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts hold no toxic passage and stay; rows that repeat are scored each; without labels of both kinds all stay.
    """
    small_batches(spark)
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars is counted anew where lines went.

    Null texts stay null; a document of boilerplate alone stays, with an empty text; rows that repeat are documents each.
    """
    lines, dropped = (max(docs.columns, key=len) + x for x in ("_lines", "_dropped"))  # names that docs cannot have
    cleaned = line_dedup.drop_boilerplate(docs, counts=(lines, dropped))
    n = F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.select(*(n.alias(c) if c == "n_chars" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest id.

    Null, empty and wordless texts are one group; of rows that share an id, those of different texts are documents each, and equal ones are
    one; rows without id stay; an empty table gives no rows.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences. A null or empty text is a piece of one id; rows that repeat are packed each."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_classifier), ("toxicity", toxicity_filter), ("line dedup", boilerplate_lines), ("simhash near-dedup", near_duplicates), ("packing", retrieval_packing)]
#: Trained models and tokenizers are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
