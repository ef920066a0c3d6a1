"""What several training-data operators share: storage that outlives executors, word blocks, folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temp folder only on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _ROOT.setdefault("tmp", "file://" + tempfile.mkdtemp(prefix="folio-"))


def _remove(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch space
        pass


def stash(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return spark.read.schema(df.schema).parquet(path)


def fold(col: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo; a null id falls in no fold (null)."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


def bytes_column(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column's UTF-8 bytes, undecoded."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def table(df: DataFrame, kinds: dict[str, str], **more: Column) -> DataFrame:
    """Only the named columns, cast, and more: extra columns, also with clashing names, fall away; a missing one is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()], *[v.alias(c) for c, v in more.items()])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, so that rows without doc_id, or under one doc_id, are told apart."""
    kept = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*kept)


def pieces(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """text cut at spaces into pieces of about size bytes, so that long texts never become one word list."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def keep_rows(docs: DataFrame, decide: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """docs with all its columns, without the rows whose text is turned down. decide is called in the task and gives the judge of a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = decide()
        for b in batches:
            for at in chunks(b.num_rows, 2000):
                part = b.slice(at.start, at.stop - at.start)
                yield part.filter(pa.array(judge(part.column(part.schema.get_field_index("text")).to_pylist()), pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few of their values are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def chunks(n: int, size: int) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))


def as_batch(schema: pa.Schema, **cols: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols[f.name] if isinstance(cols[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(cols[f.name], type=f.type, from_pandas=isinstance(cols[f.name], np.ndarray) and cols[f.name].dtype == object) for f in schema], schema=schema)
