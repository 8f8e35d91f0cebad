"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it written and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.llm.common import bounded_batches, table, written
from evidra.llm.jaccard import unique_documents
from evidra.llm.langid import language_kept
from evidra.llm.packing import packed
from evidra.llm.queries import bpe_file
from evidra.llm.tiling import decontaminated
from evidra.llm.weak_quality import quality_kept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in a language that the model tells."""
    bounded_batches(spark)
    return language_kept(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules hold for good."""
    return quality_kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return unique_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark item is covered."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a training sequence."""
    return packed(docs, bpe_file(), end_id=0)


STAGES = [
    ("language id", language),
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The language model, the votes' estimate and the packing cannot be put in SQL; tests hold every stage
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs)
    return docs
