"""Incremental ingestion: new files of a landing folder become committed documents, once each."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import content_id
from folio.operators.chunking import Sizes, chunk_pages
from folio.operators.scoring import Scorer, scored
from folio.sources.files import MOST_BYTES, Parser, page_rows, parse_pages, safe_name, starts_with, text_pages

#: What a document goes through; its status rows name the last stage that it reached.
STAGES = ("ingestion", "chunking", "persistence", "embedding", "completed")


def ingest(
    spark: SparkSession, landing: str, out: str, checkpoint: str, parser: Parser = text_pages, sizes: Sizes = Sizes(), *, most_bytes: int = MOST_BYTES, magic: bytes | None = None, embed: Callable[[Column], Column] | Scorer | None = None,
) -> None:
    """Process the files that have come since the last run, then stop.

    A file that is empty (where Spark's source hands it on), larger than most_bytes, or doesn't begin with magic, fails for good; so does one that the parser can't read.
    A batch parses its files once; it writes pages, chunks (with vectors, if embed is given: a Column of the text, or a scorer of it) under
    its own number, overwriting what a broken attempt left, and its status rows last: they commit it. So a batch that runs again leaves the same tables, and no document counts as processed before
    its vectors are there. Any other error fails the batch, which the next run takes up again.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(landing)

    def batch(df: DataFrame, n: int) -> None:
        problem = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large")
        if magic:
            problem = problem.when(~starts_with(F.col("content"), magic), "wrong_type")
        f = df.select("path", safe_name(F.col("path")).alias("name"), "length", "content", content_id(F.col("content")).alias("document_id"), problem.alias("problem")).dropDuplicates(["document_id"])
        f.select("document_id", "name", "length").write.mode("overwrite").parquet(f"{out}/documents/batch={n}")
        parse_pages(f, parser).write.mode("overwrite").parquet(f"{out}/parsed/batch={n}")
        pages = spark.read.schema("document_id string, page_number int, text string, problem string").parquet(f"{out}/parsed/batch={n}")
        good = pages.where("problem is null")
        page_rows(good.drop("problem")).write.mode("overwrite").parquet(f"{out}/pages/batch={n}")
        chunks = chunk_pages(good, sizes)
        if isinstance(embed, Scorer):
            chunks = scored(chunks, embed, "embedding", "text")
        elif embed is not None:
            chunks = chunks.withColumn("embedding", embed(F.col("text")))
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={n}")
        failed = F.max("problem").isNotNull()
        pages.groupBy("document_id").agg(
            F.when(failed, "failed").otherwise("processed").alias("status"), F.when(failed, STAGES[0]).otherwise(STAGES[-1]).alias("stage"), F.max("problem").alias("error"), F.count("page_number").alias("pages"),
        ).write.mode("overwrite").parquet(f"{out}/status/batch={n}")

    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_retries(run: Callable[[], None], most: int = 3, wait: float = 1.0, permanent: tuple[type[Exception], ...] = (ValueError,), jitter: float = 0.5, longest: float = 600.0) -> int:
    """run, again after an error that may pass, at most so many times more. Gives the number of failed attempts.

    Waits double up to the longest, and are drawn from the last jitter of that, so that tasks that failed together don't come back together.
    """
    for attempt in range(most + 1):
        try:
            run()
            return attempt
        except permanent:
            raise
        except Exception:  # noqa: BLE001  transient until the attempts are used up
            if attempt == most:
                raise
            time.sleep(min(longest, wait * 2**attempt) * random.uniform(1 - jitter, 1))
    return most


def committed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of the batches whose status was written; a document that came twice counts as in its first batch."""
    status = spark.read.parquet(f"{out}/status")
    if table == "status":
        return status
    first = status.where("status = 'processed'").groupBy("document_id").agg(F.min("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{table}").join(first, ["document_id", "batch"], "left_semi")
