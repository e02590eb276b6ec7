"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex for the white space that separates words (\x20 and \x09-\x0D).
WS = "[ \\t-\\r]+"
#: The same set for str.translate/str.split replacements in Python.
WS_CHARS = " \t\n\x0b\x0c\r"
#: A table of at most so many rows, each of a few short columns, is broadcast (about 10 MB); a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Keys that hold more than 1/HOT_PARTS of the rows: there are fewer than HOT_PARTS of them, whatever the input's size.
HOT_PARTS = 2_000
#: Bits of the filter that is sent to the rows of a long table, 2048 rows of 4 KB, whatever the input's size.
FILTER_BITS = 2048 * 32_768
#: Bytes of the rows of an Arrow batch for Python workers, about, where `small_batches` holds.
BATCH_BYTES = 4 << 20
#: Files of which a sample takes its rows.
SAMPLE_FILES = 4

_dirs: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir, which driver and executors share.

    Where it is unset (tests in local mode) a temporary folder is set; on a cluster that would lose data, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_llm_scratch", None)
        if not found:
            found = spark._llm_scratch = tempfile.mkdtemp(prefix="llm-scratch-")
    return found.rstrip("/")


def write_table(df: DataFrame, name: str) -> str:
    """Write df to a fresh Parquet folder below scratch_dir and return its path."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _dirs.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut df's lineage: write it to the shared folder and read it again.  Lost executors cost no recomputation."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """df as a written table with its rows numbered from 0 without gaps in `column`: along the partitions' order, and in each as its rows come.

    Only the partitions' counts pass through the driver.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    told = materialize(df.withColumn("__part", F.shiftright(at, 33)).withColumn("__seq", at.bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = sorted((r["__part"], r["count"]) for r in told.groupBy("__part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    before = spark.createDataFrame(starts, "__part long, __start long")
    return told.join(F.broadcast(before), "__part").withColumn(column, F.col("__start") + F.col("__seq")).drop("__part", "__seq", "__start")


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system, which knows every store that Spark can write to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _dirs:
        try:
            if spark.sparkContext._jsc is not None:
                drop_table(spark, path)
        except Exception:  # the JVM may be gone; the folder then stays for the cluster's own cleaning
            return


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building the array's filter: splits minus empty ends."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def small_rows(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether a written df has at most `bound` rows (each of its partitions is read to bound + 1 rows at most)."""
    return df.limit(bound + 1).count() <= bound


def bits(listed: DataFrame, key: Column) -> DataFrame:
    """(slot, bitmap): the keys of `listed` hashed into FILTER_BITS bits, at most 8 MB however many keys there are."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return listed.select(F.floor(at / 32_768).cast("int").alias("__slot"), (at % 32_768).alias("__at")).groupBy("__slot").agg(F.bitmap_construct_agg("__at").alias("__bitmap"))


def parted(docs: DataFrame, key: Column, listed: DataFrame, listed_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among the listed, rows whose key may be): a filter of bounded size decides where the rows lie.

    The second part holds all listed rows, and of the others as many as share a bit with a listed key, so an exact join of that
    part alone gives whole results: at a few listed rows it moves only these, at very many it becomes the plain join.  A null key hashes like any value.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    told = docs.withColumn("__slot", F.floor(at / 32_768).cast("int")).join(F.broadcast(bits(listed, listed_key)), "__slot", "left")
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), F.floor((at % 32_768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return told.where(~maybe).select(*docs.columns), told.where(maybe).select(*docs.columns)


def bitmap(listed: DataFrame, key: Column) -> bytes:
    """The same filter over a column of longs that are hashes already, FILTER_BITS / 8 bytes, for `in_bitmap`."""
    at = F.pmod(key, F.lit(FILTER_BITS))
    rows = listed.select(F.floor(at / 32_768).cast("int").alias("slot"), (at % 32_768).alias("at")).groupBy("slot").agg(F.bitmap_construct_agg("at").alias("b")).collect()  # at most 2048 rows
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r.slot * 4096 : (r.slot + 1) * 4096] = r.b
    return bytes(out)


def in_bitmap(found: bytes, key: int) -> bool:
    at = key % FILTER_BITS
    return bool(found[at >> 3] >> (at & 7) & 1)


def sample_rows(docs: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """About `rows` rows, not more, in equal parts of SAMPLE_FILES files chosen by hash of their names; the first ones where docs are not of files."""
    names = sorted({f.rpartition("/")[2] for f in docs.inputFiles()}, key=lambda n: (zlib.crc32(n.encode()), n))[:SAMPLE_FILES]
    first = docs.select(*columns).limit(rows)
    if not names:
        return first
    try:
        parts = [docs.where(F.col("_metadata.file_name") == n).select(*columns).limit(rows // len(names)) for n in names]
    except AnalysisException:  # a plan that no longer shows its files
        return first
    return reduce(DataFrame.unionAll, parts)


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches end at BATCH_BYTES, if they did not before: by rows alone, or Spark's 64 MB, texts stand in the JVM's and the workers' memory several times."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def collect_garbage(spark: SparkSession) -> None:
    """Every executor's JVM collects its garbage and gives back the heap that it no longer needs, if its task slots are free.

    Executors keep a heap at the size that the heaviest step had once, and direct buffers until the objects that own them are collected.
    """
    gc.collect()  # DataFrames and broadcasts that nothing holds
    spark.sparkContext._jvm.System.gc()
    slots = spark.sparkContext.defaultParallelism
    told = spark.range(0, slots, 1, slots).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("told"))
    told.write.format("noop").mode("overwrite").save()


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that gives its memory back at the end of a task: workers are used again, by other stages too."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def lookup_join(left: DataFrame, right: DataFrame, on: str, weight: str) -> DataFrame:
    """Left join of many rows to a materialized table with one row per key; `weight` (dropped) is the number of left rows of the key.

    A key may hold any share of the left rows.  A small right side is broadcast.  Otherwise the keys that hold more than
    1/HOT_PARTS of all rows - fewer than HOT_PARTS keys, so a bounded broadcast - are joined by broadcast and the
    others by shuffle, where no key exceeds rows/HOT_PARTS.  `on` may not be null on the right side; null keys on the left stay unmatched.
    """
    cols = [c for c in right.columns if c != weight]
    if small_rows(right):
        return left.join(F.broadcast(right.select(*cols)), on, "left")
    limit = right.agg(F.sum(weight)).first()[0] // HOT_PARTS + 1
    values = [c for c in cols if c != on]
    hot = right.where(F.col(weight) > limit).select(on, *(F.col(c).alias(f"__hot_{c}") for c in values), F.lit(True).alias("__hot"))
    cold = right.where(F.col(weight) <= limit).select(on, *(F.col(c).alias(f"__cold_{c}") for c in values), F.lit(0).cast("long").alias("__salt"))
    # Rows of a hot key are done after the first join; a salt that the second one does not know spreads them over its tasks.
    tagged = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot"), 1 + F.monotonically_increasing_id() % 100_000).otherwise(0))
    out = tagged.join(cold, [on, "__salt"], "left")
    return out.select(*left.columns, *(F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c) for c in values))
