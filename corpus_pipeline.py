"""From raw documents to piece ids: ``run(spark, sf_dir)`` applies ``STAGES`` to the table ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of the documents:

1. quality: documents that a rule rejects go;
2. near_copies: of each group of documents linked by a Jaccard similarity of 0.75 of their word shingles, the one with
   the smallest id stays;
3. decontamination: documents that hold a passage of ``benchmark`` go;
4. personal_data: personal data in the texts is replaced by its kind in brackets;
5. encoding: the texts become piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strikelake.llm import lattice, parity_join, phrase_index, pii, quality
from strikelake.llm.components import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrase_index.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lattice.encode(docs)


STAGES = [
    ("quality", good_documents),
    ("near_copies", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("encoding", encoded),
]

# The boosted trees of the fourth stage and the lattice of the last one have no SQL form; the tests hold the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
