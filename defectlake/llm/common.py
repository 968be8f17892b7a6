"""Shared helpers: whole-text readers, shared-folder tables and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only in local mode, where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Shelf:
    """Parquet tables in the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.made = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.shelf_path = path
        return table

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing lazy reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.shelf_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict = {}


def thrifty() -> None:
    """Large arrays go back to the system when freed, instead of staying in the worker's heap."""
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        c.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    pa.set_memory_pool(pa.system_memory_pool())


def keep_one(key, make):
    """The value of `key` in this Python worker, made when asked for first.

    Workers are reused by later stages, so only one operator's tables stay: a new key drops others.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        thrifty()
        _kept[key] = make()
    return _kept[key]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The whole texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(batches, rows: int = 512):
    """Parts of Arrow batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def connected_components(shelf: Shelf, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node reachable.

    Alternating star contraction: each round links neighbours to the smallest one they share, so
    the number of rounds is logarithmic. Every round is two aggregations with map-side combine and
    two equi-joins, and its table is written to the shared folder. Self-loops, repeated edges and
    an empty table are fine.
    """

    def links(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.col(a).alias("u"), F.col(b).alias("v"))

    def pairs(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()

    now = shelf.put(pairs(links(edges, "a", "b")))
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(links(now, "v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = links(small, "v", "m").unionByName(links(least, "u", "m"))
        after = shelf.put(pairs(small))
        shelf.drop(now)
        now, then, seen = after, seen, mark(after)
        if seen == then:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
