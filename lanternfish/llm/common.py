"""Shared pieces of the training-data operators: word rules, tables that cut lineage, fresh column names."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one only on a local master where none is set, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lanternfish-")
        sc.setCheckpointDir(at)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a Parquet table in the shared folder and returns a scan of it; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _open.append(out)
    return out


#: Tables of materialize() that are not deleted yet.
_open: list[DataFrame] = []


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        _open[:] = [x for x in _open if x is not df]
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of materialize() that are deleted at the end of a with block."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.tables)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.own(materialize(df, name))

    def own(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        discard(*tables)
        self.tables = [t for t in self.tables if not any(t is x for x in tables)]


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The frame that make() gives as a written table; whatever else was written to make it is deleted."""
    before = {id(x) for x in _open}
    out = materialize(make(), name)
    discard(*[x for x in _open if id(x) not in before and x is not out])
    return out


BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, Arrow batches of the session are small: rows that hold whole texts fill memory long before the usual 10,000. For actions; the setting is read when one runs."""
    old = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of text; empty for null, empty or blank text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WS_CLASS + "+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe(docs: DataFrame, wanted: DataFrame, n: int, name: str) -> DataFrame:
    """docs with the boolean name: false only where doc_id is not among the n of wanted (doc_id), and for most of these, by one bit a hash: 16 MB at most, whatever n is; only speed depends on it."""
    bits = 1 << min(27, max(15, (16 * n).bit_length()))
    bucket, place, map_ = (fresh(docs, x) for x in ("_bucket", "_place", "_map"))
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)) + 1
    maps = wanted.select(F.bitmap_bucket_number(slot).alias(bucket), F.bitmap_bit_position(slot).alias(place)).groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(map_))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(map_), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte.cast("bigint"), F.pmod(at, F.lit(8)).cast("int")) == 1
    return docs.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col(bucket), "left").select(*docs.columns, F.coalesce(hit, F.lit(False)).alias(name))


def maybe_in(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """docs without most rows whose doc_id is not among the n of wanted (doc_id)."""
    name = fresh(docs, "_maybe")
    return maybe(docs, wanted, n, name).where(name).drop(name)


SLICE = 1 << 15


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """batch in parts, as large batches make the JVM's native memory grow for good."""
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)


def tidy() -> None:
    """Gives memory that a task no longer holds back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another
        ctypes.CDLL("libc.so.6").malloc_trim(0)
