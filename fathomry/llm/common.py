"""Helpers shared by the text operators: reading tables, staging tables in the shared folder, hold-out split."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII blanks; ``bytes.split()`` cuts at exactly these.
BLANKS = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a temporary folder, but only if this machine runs all tasks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='fathomry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Staged tables that still exist, oldest first.
_staged: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its own cleaner owns the folder
        pass


def _remove_all(spark: SparkSession) -> None:
    while _staged:
        _remove(spark, _staged.pop())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs a
    reread instead of a recomputation.

    The files go when the driver process ends, or earlier by ``discard`` or ``finished``. They lie in a folder named after
    the application, so what a killed driver leaves can be told and removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fathomry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_remove_all, spark)
    _staged.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathomry_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    path = df._fathomry_path
    if path in _staged:
        _staged.remove(path)
        _remove(df.sparkSession, path)


def finished(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The staged result of ``build``; all tables that were staged on the way to it are removed."""
    before = len(_staged)
    out = staged(build(), name)
    for path in _staged[before:-1]:
        _staged.remove(path)
        _remove(out.sparkSession, path)
    return out


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


#: Bits of a screen: 16 a key, so that about one other key in 16 passes, but never more than 2^27 (16 MB).
SCREEN_PER_KEY, SCREEN_LEAST, SCREEN_MOST, SCREEN_ROW = 16, 1 << 18, 1 << 27, 1 << 15


def screened(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``__maybe``: false only where ``key`` is surely not among ``keys`` (one string column).

    A bitmap of the keys' hashes of at most ``SCREEN_MOST`` bits is broadcast, so that rows without a match need no shuffle.
    With more keys than it is made for it passes more rows, never fewer: an exact join has to follow.
    """
    bits = SCREEN_LEAST
    n = keys.count()
    while bits < SCREEN_MOST and bits < n * SCREEN_PER_KEY:
        bits *= 2
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits))
    row, bit = F.floor(at / SCREEN_ROW).cast("int"), at % SCREEN_ROW
    maps = keys.select(row.alias("__row"), bit.alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    placed = df.withColumns({"__row": F.floor(at / SCREEN_ROW).cast("int"), "__bit": (at % SCREEN_ROW).cast("int")})
    byte = F.conv(F.hex(F.expr("substring(__map, __bit div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("1 << (__bit % 8)").bitwiseAND(byte) != 0, F.lit(False))
    return placed.join(F.broadcast(maps), "__row", "left").withColumn("__maybe", hit).drop("__row", "__bit", "__map")


def binary_values(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding it."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def row_slices(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no slice holds much more than ``most_bytes`` of text: long texts don't add up."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function``, after whose last batch the worker gives its free memory back: workers stay, and idle ones would hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


#: Bytes of labelled texts that a classifier is fitted on, and the most of a single text.
FIT_BYTES, FIT_TEXT = 64_000_000, 4_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int = 5) -> DataFrame:
    """At most ``rows`` training labels (doc_id, y): those not held out whose document is in ``docs``, the smallest by hash of
    the id.

    ``rows`` is the documented bound of what a classifier is fitted on. Labels of absent documents take no place in it. A
    document with contrary labels counts as 1. Only ids are shuffled to tell which documents there are.
    """
    usable = labels.where(F.col(label).isNotNull() & (crc_mod(F.col("doc_id"), modulus) != 0))
    known = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()  # so that a repeated id is one row
    return known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int = FIT_BYTES, most_text: int = FIT_TEXT) -> DataFrame:
    """doc_id, y, text: at most ``rows`` distinct labelled documents of at most ``most_bytes`` together, whole texts, for a fit.

    Rows with one id and one text count once; of the texts of all rows with the chosen ids the smallest by hash are taken
    until a bound is met, passing over texts of more than ``most_text`` bytes. Their sizes are gathered first, so neither an
    id that repeats without end nor a huge text reaches the driver.
    """
    spark = docs.sparkSession
    chosen = labelled_sample(docs, labels, label, rows)
    all_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    all_ = all_.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = all_.groupBy("h", "doc_id", "y").agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).where(F.col("n") <= most_text)
    kept, total = [], 0
    for r in sizes.orderBy("h", "doc_id").limit(rows).collect():
        total += r["n"]
        if total > most_bytes:
            break
        kept.append((r["h"], r["doc_id"], r["y"]))
    wanted = spark.createDataFrame(kept, "h long, doc_id long, y int")
    found = all_.drop("y").join(F.broadcast(wanted), ["h", "doc_id"])
    return found.groupBy("h", "doc_id", "y").agg(F.first("text").alias("text")).select("doc_id", "y", "text")


def held_out(id_col: Column, modulus: int = 5, remainder: int = 0) -> Column:
    """False for a null id, which is never learned from either."""
    return F.coalesce(crc_mod(id_col, modulus) == remainder, F.lit(False))
