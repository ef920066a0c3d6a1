"""Exact duplicates by a stateful stream: keyed state on disk, kept for good, and a check of full bytes where a digest is met again.

The stream's state has one entry for each digest: the stable identifier of the row that stays (the largest doc_id), that row's content
locator (file and row in it), and the number of rows. It lives in a disk-backed state store without watermark, so no entry expires and
files that arrive later meet the earlier ones. The changed entries of each micro-batch are written under the batch's number; a batch
that is run again after a failure overwrites its own folder. Everything is DataFrame code.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import shared_dir, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of files that a micro-batch takes in.
BATCH = 1 << 36
#: Bytes of a digest in the state; texts that share them are told apart by their bytes.
WIDTH = 16
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # each partition would set aside megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else; a null text counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def located(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, norm, sha, digest, file, row) of files' rows: digest is the first bytes of the text's SHA-256, _metadata tells where the content lies."""
    norm = normalised(F.col("text").cast("string"))
    sha = F.unhex(F.sha2(norm, 256))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), norm.alias("norm"), sha.alias("sha"), F.substring(sha, 1, width).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def keeper() -> Column:
    """Of equal texts the row with the largest doc_id (null ones last), and of those the last by file and row."""
    return F.max(F.struct("doc_id", "file", "row"))


def retain(arrivals: DataFrame, folder: str) -> None:
    """Takes in what has arrived and not yet been taken in; the state and the log of its entries are in folder.

    arrivals: a stream of (doc_id, digest, file, row). Rows are pre-aggregated in their task, so a group of any size sends one row a task.
    """
    spark = arrivals.sparkSession
    entries = arrivals.groupBy("digest").agg(keeper().alias("stays"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            entries.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
            .foreachBatch(lambda changed, number: changed.write.mode("overwrite").parquet(f"{folder}/entries/batch={number}")).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, stays, n): the newest entry of each digest."""
    log = spark.read.schema("digest binary, stays struct<doc_id: bigint, file: string, row: bigint>, n bigint, batch bigint").option("basePath", f"{folder}/entries").parquet(f"{folder}/entries")
    newest = F.max_by(F.struct("stays", "n"), "batch").alias("e")
    return log.groupBy("digest").agg(newest).select("digest", "e.stays", "e.n")


def unequal(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The digests under which rows of different bytes lie.

    Only digests met more than once are looked at. Equal texts are those whose least and greatest are one; both are pre-aggregated.
    The rebalance lets a digest that holds a large share of the rows be split before that.
    """
    again = stash(state.where("n > 1").select("digest"))
    hits = rows.join(again, "digest", "left_semi").select("digest", "norm").hint("rebalance")
    return hits.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("unequal")).where("unequal").select("digest")


def resolve(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha) of every row, by the state's entries; rows whose digest is shared by unequal texts are
    grouped by the texts themselves."""
    odd = stash(unequal(rows, state))
    stays = (F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))
    mark = ["doc_id", F.col("stays.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), "sha"]
    slim = rows.select("doc_id", "sha", "digest", "file", "row")
    if not odd.limit(1).count():
        return slim.join(state, "digest").select(*mark)
    apart = stash(rows.join(odd, "digest", "left_semi"))
    own = apart.groupBy("digest", "norm").agg(keeper().alias("stays"), F.count("*").alias("n"))
    return slim.join(state.join(odd, "digest", "left_anti"), "digest").select(*mark).unionByName(apart.join(own, ["digest", "norm"]).select(*mark))


def deduplicate(spark: SparkSession, path: str, width: int = WIDTH, batch: int = BATCH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of the Parquet documents at path, dropped ones too.

    Rows are equal when their texts are after A-Z is lower-cased; null counts as empty, and empty texts form a group. The largest doc_id
    stays; among rows that share it, or all lack it, the last by file and row, so of repeated rows exactly one is kept. Texts of any
    length are digested whole. Other columns, also clashing ones, are not read. An empty table gives no rows.
    """
    folder = f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    kinds = spark.read.parquet(path).select("doc_id", "text").schema
    # as a pattern, the path may be a file or a folder
    arrivals = spark.readStream.schema(kinds).option("maxBytesPerTrigger", batch).parquet(f"{path[:-1]}[{path[-1]}]")
    retain(located(arrivals, width).select("doc_id", "digest", "file", "row"), folder)
    out = resolve(located(spark.read.schema(kinds).parquet(path), width), stash(entries(spark, folder)))
    return out.withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")
