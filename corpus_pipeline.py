"""The corpus pipeline: toxicity, exact and near de-duplication, mixing, packing.

``STAGES`` lists (name, function); each function takes the session, the documents that its predecessor kept and the
folder of the tables, and returns a DataFrame.  All but the last return the columns of ``documents``.  ``run`` applies
them to the whole table, each stage's result written as Parquet and read again as the next one's input.

Defined cases, the same in every stage: rows are told apart as rows, so null and repeated ids lose no text; a null text
is an empty one; other columns, whatever their names, are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from quarrystone.llm.common import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject.  Equal rows are judged alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the least id, null last; of ties any one.

    Empty and null texts are one group.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents that share 80 % of their five-word shingles: the one with the least id.

    Texts without words link with nothing and stay.
    """
    return jaccard_join.keep_representatives(docs, width=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the source targets, some repeated.  Texts without words take nothing and go."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1,024 tokens.  An empty text is its end id."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: The toxicity model is learnt outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs), sf_dir)
    return docs
