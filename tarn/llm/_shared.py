"""What several operators need: shared storage, word patterns and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

import tarn
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.session import configure

#: Functions for Python workers travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(tarn)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, as a Java pattern.
SPACES = "[\\x20\\x09-\\x0D]+"


#: Settings of a write: shuffle files go when it has ended, since its rows are read from the files written; and so many folders are filled at once, without sorting rows by folder.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "16"}
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LEFT: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session in one process may do without: it gets one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tarn-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tarn/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, by: str | None = None, codec: str = "zstd") -> None:
    """Writes Parquet, in a folder for each value of `by`; shuffle files behind it go at once."""
    spark = configure(df.sparkSession)
    before = {key: spark.conf.get(key) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", codec).partitionBy(*[by] * bool(by)).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: lineage is cut, and lost executors lose nothing.

    The folder goes with discard(), or when Python ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    save(df, path)
    return _found(spark, path, df.schema)


def _found(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    made = spark.read.schema(schema).parquet(path)
    _FOLDERS[made] = path
    _LEFT[path] = spark
    return made


def sliced(df: DataFrame, name: str, key: Column, n: int) -> list[DataFrame]:
    """The rows as stored() keeps them, in n frames by the key: what is joined slice by slice has only a slice in shuffle files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    save(df.withColumn("_slice", F.pmod(key, F.lit(n)).cast("int")), path, "_slice", "snappy")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in range(n):  # a slice without rows has no folder yet
        files.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_slice={k}"))
    return [_found(spark, f"{path}/_slice={k}", df.schema) for k in range(n)]


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() has written for these frames; nothing that is still to be run may read them."""
    for frame in frames:
        if path := _FOLDERS.pop(frame, None):
            _delete(path)


def _delete(path: str) -> None:
    context = _LEFT.pop(path).sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_left() -> None:
    for path in list(_LEFT):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)


def ascii_lower(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separators: str = SPACES) -> Column:
    """Words between separators, without empty strings; null gives no word."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its connected component.

    Large-star and small-star steps alternate until the stars stop changing. Each round is written to the shared
    folder; the driver sees three numbers per round. A node with very many neighbours is only ever the key of a
    pre-aggregated minimum and of a join, whose hot partitions the engine may split.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    sign = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        before, now = now, stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
