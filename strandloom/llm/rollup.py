"""Token counts kept as additive rollups by signed deltas.

A batch is a table of changes (key, source, lang, tokenizer version, op, tokens) with op insert,
revise or delete.  Committing it writes two small tables under the rollup's folder: `ledger`,
one signed row per change and document, and `deltas`, the changes summed by source, language
and tokenizer version.  A batch becomes visible by one rename of its folder, and a batch id
that is already there is not applied again; so retries and replays change nothing.  Totals are
the sum of all deltas; nothing that was committed is rewritten.  A rollup has one writer at a time: of
two that commit the same batch one wins, but two batches at once would be judged by the same ledger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
#: Files of a batch's tables where the cluster has fewer cores than this.
MIN_FILES = 8
LEDGER = "batch long, id long, source string, lang string, tokenizer string, docs long, tokens long"
DELTAS = "batch long, source string, lang string, tokenizer string, docs long, tokens long"


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Ids of the committed batches."""
        found = []
        if self._fs.exists(self._path(f"{self.root}/batches")):
            for s in self._fs.listStatus(self._path(f"{self.root}/batches")):
                found.append(int(s.getPath().getName().removeprefix("b")))
        return sorted(found)

    def _read(self, kind: str, schema: str) -> DataFrame:
        have = self.batches()
        if not have:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/batches/b{b}/{kind}" for b in have))

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (id, source, lang, tokenizer, op, tokens); False if this batch was applied before.

        insert adds a document (one that is there already is left as it is); revise takes the old count
        back and adds the new one, where the document is there; delete takes it back.  Keys are
        (id, tokenizer); a batch holds a key once: of repeats, the last op in the order delete,
        revise, insert and then the largest count holds.  Null tokens count 0; null source or lang are
        groups of their own; rows with a null id or an unknown op are left out.
        """
        if self._fs.exists(self._path(f"{self.root}/batches/b{batch}")):
            return False
        rank = F.when(F.col("op") == "insert", 2).when(F.col("op") == "revise", 1).when(F.col("op") == "delete", 0)
        new = (
            changes.select(F.col("id").cast("long").alias("id"), *KEYS, F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), rank.alias("rank"))
            .filter("id is not null and rank is not null and tokenizer is not null")
            .groupBy("id", "tokenizer").agg(F.max(F.struct("rank", "tokens", "source", "lang")).alias("c")).select("id", "tokenizer", "c.*")
        )
        if self.batches():
            old = self.ledger().groupBy("id", "source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("had")).filter("docs > 0")
            old = old.select("id", "tokenizer", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), "had", F.lit(True).alias("there"))
        else:
            old = self.spark.createDataFrame([], "id long, tokenizer string, old_source string, old_lang string, had long, there boolean")
        both = new.join(old, ["id", "tokenizer"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
        take = (F.col("rank") < 2) & F.col("there")
        give = ((F.col("rank") == 2) & ~F.col("there")) | ((F.col("rank") == 1) & F.col("there"))
        rows = both.select(
            F.lit(batch).cast("long").alias("batch"), "id", "tokenizer",
            F.explode(F.array(
                F.struct(take.alias("on"), F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).cast("long").alias("docs"), F.negative("had").alias("tokens")),
                F.struct(give.alias("on"), F.col("source"), F.col("lang"), F.lit(1).cast("long").alias("docs"), F.col("tokens")),
            )).alias("d"),
        ).filter("d.on").select("batch", "id", "d.source", "d.lang", "tokenizer", "d.docs", "d.tokens")
        stage = f"{self.root}/staging/{uuid.uuid4().hex}"
        # a ledger of few, larger files, on as many tasks as there are cores
        rows.coalesce(max(MIN_FILES, self.spark.sparkContext.defaultParallelism)).write.parquet(f"{stage}/ledger")
        written = self.spark.read.schema(LEDGER).parquet(f"{stage}/ledger")
        written.groupBy("batch", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).coalesce(MIN_FILES).write.parquet(f"{stage}/deltas")
        self._fs.mkdirs(self._path(f"{self.root}/batches"))
        target = f"{self.root}/batches/b{batch}"
        done = self._fs.rename(self._path(stage), self._path(target))
        # where another writer was first, a rename fails or puts the folder into the one that is there
        nested = self._path(f"{target}/{stage.rsplit('/', 1)[1]}")
        if self._fs.exists(nested):
            self._fs.delete(nested, True)
            done = False
        if not done:
            self._fs.delete(self._path(stage), True)
        return bool(done)

    def taken(self, batch: int) -> DataFrame:
        """What a committed batch took back, as changes that insert it again."""
        back = self.ledger().filter((F.col("batch") == batch) & (F.col("docs") < 0))
        return back.select("id", *KEYS, F.lit("insert").alias("op"), F.negative("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all groups with documents."""
        return self._read("deltas", DELTAS).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter("n_docs > 0")

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)


def word_count(text):
    """Words between white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_piece_count(text):
    """Runs of ASCII letters or digits, and single characters of all others that are not white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")).cast("long")


def document_rollup(rollup: TokenRollup, docs: DataFrame) -> DataFrame:
    """Batches over a table of documents (doc_id, text, source, lang, n_chars), then the totals.

    1 inserts every document under both tokenizer versions with a quarter of its characters as a
    provisional count; 2 revises all counts to the real ones; 3 deletes all but the smallest id
    of equal texts; 4 inserts again what 3 took; then 2 is sent again, which changes nothing.  So the
    totals cover every document.  Null texts count 0; a null source or lang is a group of its own;
    documents with a null id are left out; of rows with one id the largest count holds; other columns
    are not looked at; an empty table gives no rows.
    """
    names = F.array(F.lit("words-1"), F.lit("pieces-1"))
    base = docs.select(F.col("doc_id").alias("id"), "source", "lang", "text")
    first = base.select("id", "source", "lang", F.explode(names).alias("tokenizer"), F.lit("insert").alias("op"), F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 4).alias("tokens"))
    counts = base.select("id", "source", "lang", F.explode(F.arrays_zip(names.alias("name"), F.array(word_count(F.col("text")), word_piece_count(F.col("text"))).alias("n"))).alias("t"))
    real = counts.select("id", "source", "lang", F.col("t.name").alias("tokenizer"), F.lit("revise").alias("op"), F.col("t.n").alias("tokens"))
    keys = base.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    low = keys.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("h", "low")
    gone = keys.join(low, "h").filter("id > low").select("id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.explode(names).alias("tokenizer"), F.lit("delete").alias("op"), F.lit(0).alias("tokens"))
    rollup.commit(1, first)
    rollup.commit(2, real)
    rollup.commit(3, gone)
    rollup.commit(4, rollup.taken(3))
    rollup.commit(2, real)
    return rollup.totals()
