"""Document, page, chunk and vector tables: appends, upserts, cascades, paging, a status log, integrity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temp folder, on a local master only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="folio-"))
    return _LOCAL[0]


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_id(table: DataFrame, column: str, value: object) -> DataFrame:
    return table.where(F.col(column) == value).limit(1)


def page_of(table: DataFrame, newest: str, tie: str, skip: int, limit: int) -> DataFrame:
    """Newest first, by offset and limit."""
    return table.orderBy(F.desc_nulls_last(newest), tie).offset(skip).limit(limit)


def count(table: DataFrame) -> int:
    return table.count()


def page_of_document(pages: DataFrame, document_id: object, page_number: int) -> DataFrame:
    return pages.where((F.col("document_id") == document_id) & (F.col("page_number") == page_number)).limit(1)


def chunks_of_document(chunks: DataFrame, document_id: object, page_number: int | None = None) -> DataFrame:
    """In reading order; of one page only, if given."""
    own = chunks.where(F.col("document_id") == document_id)
    return (own if page_number is None else own.where(F.col("page_number") == page_number)).orderBy("page_number", "chunk_index")


def embedding_of(chunks: DataFrame, key: str, value: object, column: str = "embedding") -> list[float] | None:
    found = chunks.where(F.col(key) == value).select(column).limit(1).collect()
    return found[0][0] if found else None


def unembedded(chunks: DataFrame, column: str, oldest: str, tie: str, limit: int | None = None) -> DataFrame:
    """Chunks without a vector, oldest first; at most limit of them, if given."""
    left = chunks.where(F.col(column).isNull()).orderBy(oldest, tie)
    return left if limit is None else left.limit(limit)


def chunks_for_questions(stored: DataFrame, indexed: DataFrame, document_id: object, page_number: int | None = None) -> DataFrame:
    """The stored chunks of a document (and page); those of the index where none is stored."""
    own = chunks_of_document(stored, document_id, page_number)
    return own if own.limit(1).count() else chunks_of_document(indexed, document_id, page_number)


def upsert_vectors(chunks: DataFrame, new: DataFrame, key: str, column: str, dimension: int) -> DataFrame:
    """chunks with the new vectors in place. A wrong dimension or a repeated key among the new ones fails before anything is written."""
    if new.where(F.col(column).isNull() | (F.size(column) != dimension)).limit(1).count():
        raise ValueError(f"vectors must have {dimension} dimensions")
    if new.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} must not repeat among new vectors")
    n = new.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return chunks.join(n, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def clear_vectors(chunks: DataFrame, column: str, where: Column) -> DataFrame:
    v = F.when(~F.coalesce(where, F.lit(False)), F.col(column))
    return chunks.withColumn(column, v)


def without_documents(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """The tables without the documents of gone: the cascade of a delete."""
    ids = gone.select(key).distinct()
    return {n: t.join(ids, key, "left_anti") for n, t in tables.items()}


def current_status(log: DataFrame, key: str = "document_id") -> DataFrame:
    """The last status of each document in an appended log (key, at, status, stage, error); the last error stays till another comes."""
    return log.groupBy(key).agg(F.max_by("status", "at").alias("status"), F.max_by("stage", "at").alias("stage"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("error"), F.max("at").alias("updated_at"))


def replace_document(current: DataFrame, rows: DataFrame, processed: DataFrame, key: str = "document_id") -> DataFrame:
    """current with the rows of new documents in place of their partial ones; processed documents are left as they are."""
    new = rows.join(processed.select(key).distinct(), key, "left_anti")
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


class BrokenRows(ValueError):
    """Rows that a commit must not take: violations of uniqueness, references or ranges."""


def _manifest(spark: SparkSession, root: str, key_type: str = "bigint") -> DataFrame:
    """(document_id, attempt, seq, status) of all committed attempts; none yet: no rows."""
    from pyspark.errors import AnalysisException

    kinds = f"document_id {key_type}, attempt string, seq bigint, status string"
    try:
        return spark.read.schema(kinds).parquet(f"{root}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], kinds)


def latest(spark: SparkSession, root: str, key_type: str = "bigint") -> DataFrame:
    """(document_id, attempt, status): what each document's last committed attempt is."""
    return _manifest(spark, root, key_type).groupBy("document_id").agg(F.max_by(F.struct("attempt", "status"), "seq").alias("m")).select("document_id", "m.attempt", "m.status")


def stage(root: str, attempt: str, tables: dict[str, DataFrame]) -> None:
    """The rows of an attempt, under its name; nobody reads them before they are committed."""
    for name, rows in tables.items():
        rows.withColumn("attempt", F.lit(attempt)).write.mode("overwrite").partitionBy("attempt").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{name}")


def persist(root: str, tables: dict[str, DataFrame], attempt: str, status: str = "processed") -> DataFrame:
    """Commits documents, pages and chunks as one: document ids that were processed before, and so are left out.

    A document that is processed stays as it is; any earlier rows of another are replaced as a whole. Rows are staged, checked, and
    committed by a manifest that is written last, in one piece: an attempt that breaks off at any point before changes nothing for readers,
    and can be run again under its name. Attempts follow one another; two at once are not told apart in time.
    """
    spark, kind = tables["documents"].sparkSession, dict(tables["documents"].dtypes)["document_id"]
    done = materialise(latest(spark, root, kind).where("status = 'processed'").select("document_id"))
    new = {n: t.join(done, "document_id", "left_anti") for n, t in tables.items()}
    stage(root, attempt, new)
    staged = {n: spark.read.parquet(f"{root}/{n}").where(F.col("attempt") == attempt) for n in tables}
    broken = [r.rule for r in violations(staged["documents"], staged["pages"], staged["chunks"]).where("n > 0").collect()]
    if broken:
        raise BrokenRows(f"attempt {attempt}: {', '.join(sorted(broken))}")
    seq = _manifest(spark, root, kind).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first().s + 1
    rows = staged["documents"].select("document_id", F.lit(attempt).alias("attempt"), F.lit(seq).cast("bigint").alias("seq"), F.lit(status).alias("status"))
    rows.write.mode("append").parquet(f"{root}/manifest")
    return tables["documents"].join(done, "document_id", "left_semi").select("document_id")


def committed_rows(spark: SparkSession, root: str, name: str, key_type: str = "bigint") -> DataFrame:
    """The rows of each document's last committed attempt."""
    return spark.read.parquet(f"{root}/{name}").join(latest(spark, root, key_type).drop("status"), ["document_id", "attempt"], "left_semi")


def violations(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, n): rows that break uniqueness, references or ranges; all zero before a commit."""
    repeat = lambda t, *k: t.groupBy(*k).count().where("count > 1")
    checks = {
        "document_id unique": repeat(documents, "document_id"), "page unique": repeat(pages, "document_id", "page_number"), "chunk unique": repeat(chunks, "document_id", "page_number", "chunk_index"),
        "page has document": pages.join(documents, "document_id", "left_anti"), "chunk has page": chunks.join(pages, ["document_id", "page_number"], "left_anti"), "page_number from 1": pages.where("page_number < 1"), "chunk_index from 0": chunks.where("chunk_index < 0"),
    }
    found = None
    for rule, rows in checks.items():
        r = rows.select(F.lit(rule).alias("rule"), F.lit(1).alias("one"))
        found = r if found is None else found.unionByName(r)
    rules = documents.sparkSession.createDataFrame([(r,) for r in checks], "rule string")
    return rules.join(found.groupBy("rule").agg(F.sum("one").alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def slots_contiguous(mapping: DataFrame, slot: str = "slot") -> DataFrame:
    """One row: whether an index' slots are 0..n-1, each once."""
    return mapping.agg(F.count("*").alias("n"), ((F.count("*") == F.count_distinct(slot)) & (F.coalesce(F.min(slot), F.lit(0)) == 0) & (F.coalesce(F.max(slot), F.lit(-1)) == F.count("*") - 1)).alias("contiguous"))


class CorruptIndex(ValueError):
    """A saved index whose parts don't agree."""


def save_index(vectors: DataFrame, path: str, name: str = "index") -> None:
    """vectors (slot, ..., embedding) as Parquet, and one JSON row about them, written last: it makes the index complete."""
    vectors.write.mode("overwrite").parquet(f"{path}/{name}.vectors")
    saved = vectors.sparkSession.read.parquet(f"{path}/{name}.vectors")
    saved.agg(F.count("*").alias("total_vectors"), F.max(F.size("embedding")).alias("dimension")).coalesce(1).write.mode("overwrite").json(f"{path}/{name}.metadata")


def load_index(spark: SparkSession, path: str, name: str = "index") -> DataFrame:
    """The saved vectors, after checks of their dimension, their number, their slots (0 to n - 1, each once) and that none is missing."""
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.schema("total_vectors bigint, dimension int").json(f"{path}/{name}.metadata").first()
        vectors = spark.read.parquet(f"{path}/{name}.vectors")
    except AnalysisException as e:
        raise FileNotFoundError(f"no index {name} in {path}") from e
    if meta is None:
        raise CorruptIndex("the index has no metadata")
    found = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.size("embedding") != F.lit(meta.dimension or 0)).alias("wrong"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high")).first()
    for bad, why in ((found.n != meta.total_vectors, "the number of vectors isn't the metadata's"), (found.wrong, "vectors of another dimension"), (found.missing, "slots without a vector"), (found.n and (found.slots != found.n or found.low != 0 or found.high != found.n - 1), "slots aren't 0 to n - 1")):
        if bad:
            raise CorruptIndex(why)
    return vectors.orderBy("slot")


def add_to_index(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors (slot, vec_id, embedding) with new ones (vec_id, embedding) behind, in the order of vec_id: slots go on from the last.

    Numbers are dealt by ranges of vec_id from counts of the ranges before, so no task sees all rows.
    """
    from pyspark.sql.window import Window

    n = vectors.agg(F.coalesce(F.max("slot"), F.lit(-1)).alias("m")).first().m + 1
    ranged = materialise(new.repartitionByRange("vec_id").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    own = F.row_number().over(Window.partitionBy("_part").orderBy("vec_id")) - 1
    placed = ranged.withColumn("_own", own).join(base, "_part").withColumn("slot", (F.col("_base") + F.col("_own") + n).cast("bigint"))
    return vectors.select("slot", "vec_id", "embedding").unionByName(placed.select("slot", "vec_id", "embedding"))
