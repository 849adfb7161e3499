"""From raw documents to packed training sequences: quality, near duplicates, exact repeats, benchmark, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next
one; all but the last return the columns of documents. Nulls, empty tables, repeated rows and extra columns are
handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechlake.llm.common import work_path
from speechlake.llm.decontaminate import remove_contaminated
from speechlake.llm.exact_substring import remove_repeats
from speechlake.llm.ngram_join import keep_one_of_each
from speechlake.llm.packing import pack_documents
from speechlake.llm.quality import reject_low_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return reject_low_quality(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the smallest doc_id."""
    return keep_one_of_each(docs)


def exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document or place has already had are cut out of texts."""
    return remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("exact_repeats", exact_repeats),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
