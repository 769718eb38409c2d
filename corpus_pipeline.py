"""Training corpus from documents: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the
columns of documents.  run() chains them over the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("minhash_near_dedup", stages.keep_one_of_near_duplicates),
    ("substring_dedup", stages.drop_repeated_passages),
    ("benchmark_decontamination", stages.drop_benchmark_leaks),
    ("packing", stages.pack),
]

#: No stage but the first filter could be said in SQL: the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.spark import cut, release

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            release()
    return docs
