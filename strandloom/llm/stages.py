"""Stages of the corpus pipeline: each applies one operator's decisions to documents (doc_id, text, lang, source, n_chars).

Null and empty texts pass all filters and are packed as an end token; null ids pass, as rows of
their own; rows that repeat an id are made one by the near-duplicate stage; an empty table gives
an empty table; extra columns, whatever their names, are kept up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap, split_by
from .decontaminate import without_contaminated
from .near_dedup import near_duplicate_components
from .packing import pack_documents
from .spark import bound_batches, cut
from .substrings import remove_repeats
from .toxicity import fit, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not call toxic; null texts are not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic").filter("toxic in (0, 1)")
    model = fit(bound_batches(docs).select(F.col("doc_id").alias("id"), "text"), labels)
    return score(docs, model, docs.columns, ("__score", "__toxic")).filter("__toxic = 0").select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every component at similarity 0.8; of rows with equal ids one, null ids all."""
    found = near_duplicate_components(docs, percent=80)
    by = found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("m"))
    special = cut(by.filter("not kept or m > 1").select(F.col("doc_id").alias("__id"), F.col("kept").alias("__kept")))
    maybe, clear = split_by(docs, "doc_id", bitmap(special, "__id"))
    joined = maybe.join(special.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left")
    alone = joined.filter("__id is null").select(docs.columns)
    repeated = joined.filter("__kept").select(docs.columns).dropDuplicates(["doc_id"])
    return clear.unionByName(alone).unionByName(repeated)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller id hold; a text that loses no word stays as it is, one that loses all goes."""
    out = remove_repeats(docs, keep=docs.columns, added=("__words", "__removed", "__kept"))
    text = F.when(F.col("__removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    return (
        out.filter("__removed = 0 or __removed < __words").withColumn("text", text)
        .withColumn("n_chars", F.when(F.col("__removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        .select(docs.columns)
    )


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match no benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids."""
    from .queries import tokenizer_file

    return pack_documents(docs, tokenizer_file(), with_ids=True)
