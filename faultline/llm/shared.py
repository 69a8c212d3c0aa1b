"""What several operators need: a workspace all executors see, joins by checked size, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side of a join is broadcast; beyond them the join is shuffled.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20

_made: list[tuple[SparkSession, str]] = []
_trim: list = []
_TRIM = """
try {
    java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(
        new javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new Object[0], new String[0]);
} catch (Exception e) {
}
"""


def workspace(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    for session, path in _made:
        if session is spark and path.endswith("/workspace"):
            return path
    path = f"file://{tempfile.mkdtemp(prefix='faultline-')}/workspace"
    _made.append((spark, path))
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the workspace, removed when the driver ends."""
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the workspace through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in reversed(_made):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return


atexit.register(_remove_all)


def staged(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Writes df to the workspace and reads it back: lineage ends there, and lost executors lose nothing.

    batch: most rows of the Arrow batches that are made on the way, for rows that hold texts or sets; the session's own limit
    is set again after the write.
    """
    spark, path, key = df.sparkSession, new_folder(df.sparkSession, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = spark.conf.get(key)
    try:
        if batch is not None and int(most) not in range(1, batch + 1):
            spark.conf.set(key, batch)
        df.write.parquet(path)
    finally:
        spark.conf.set(key, most)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Removes what staged() wrote; df cannot be read afterwards."""
    remove(df.sparkSession, df._staged_at)


def _width(field: T.StructField):
    """About the bytes that a column takes in a row, as an expression."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StringType | T.BinaryType):
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0)) + 16
        return F.coalesce(F.size(c), F.lit(0)) * 16 + 16
    return F.lit(8)


def sized(small: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """small, marked for broadcast if it has at most ``most`` rows and about ``most_bytes``; it should be cheap to read."""
    n, size = extent(small.limit(most + 1))
    return F.broadcast(small) if n <= most and size <= most_bytes else small


def extent(df: DataFrame) -> tuple[int, int]:
    """Rows of df, and about their bytes."""
    widths = sum((_width(f) for f in df.schema.fields), F.lit(16))
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(widths), F.lit(0)).cast("long")).first())


def with_sums(rows: DataFrame, sums: DataFrame, keys, total: int) -> DataFrame:
    """rows joined by keys with sums, which has a row a key and in n the number of rows of that key; n is left out.

    total: the sum of n, or more. At most 4,096 keys can have more than a 4,096th of all rows each, so those few are broadcast,
    and what is dealt by key is never a large part of a task.
    """
    keys, most = list(keys), max(256, total >> 12)
    heavy = sums.where(F.col("n") > most).drop("n")
    light = sums.where(F.col("n") <= most).drop("n")
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def store(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system of a folder, and its path there."""
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def slices(batch: pa.RecordBatch, column: int, rows: int = 1_000, size: int = 4 << 20):
    """The batch in parts of at most ``rows`` rows and about ``size`` bytes of that column (a row at least).

    The session decides how large the batches are that come in; what a worker makes of one at a time is bounded here.
    """
    texts = batch.column(column)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + size, side="right"))))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def give_back() -> None:
    """Returns a Python worker's freed memory to the system: Spark keeps idle workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def give_back_driver(spark: SparkSession) -> None:
    """Returns the driver's freed memory to the system: of its Python, of the JVM's heap and of what the JVM allocated outside of it.

    A long session keeps some hundred MB outside of the heap that nothing uses. The collection also lets go of finished shuffles' files.
    """
    give_back()
    jvm, none = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, 0)
    jvm.java.lang.System.gc()
    try:
        if not _trim:  # the JVM's own command, called by code that Spark's compiler makes: Py4J cannot reach it
            script = jvm.org.codehaus.janino.ScriptEvaluator()
            script.cook(_TRIM)
            _trim.append(script)
        _trim[0].evaluate(none)
    except Exception:  # noqa: BLE001  a JVM without this command or compiler
        return


def free(name: str, taken) -> str:
    """name with as many underscores before it as make it differ from all names taken, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def without(df: DataFrame, taken) -> list:
    """The columns of df but for those whose names, whatever their case, are taken."""
    low = {c.lower() for c in taken}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in low]


def ascii_lower(c):
    """A-Z lower-cased; no other character changes."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a[i]-b[i]: the smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _contracted(batches):
    """Links of one partition, replaced by a star for each of their components."""
    for batch in batches:
        u, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots_of(len(names), at[: len(u)], at[len(u) :])
        own = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], names=["u", "v"])


def connected_components(links: DataFrame, max_rounds: int = 60, contracted: bool = False) -> DataFrame:
    """(node, component): the smallest node of each component, for every node that has a link.

    links: two columns of longs without nulls, in any order and repeated or not; loops are ignored.
    Large-star and small-star rounds on Spark's shuffles, each round written to the workspace. The
    driver sees only a row count and a checksum. A hub with many links is pre-aggregated by min, and what joins back to it
    is not dealt by its key (``with_sums``). contracted: the
    links come as forests already, so they are not contracted again, which would chain a second Python worker to the
    tasks that make them.
    """
    spark = links.sparkSession
    u, v = (F.col(c) for c in links.columns[:2])
    pairs = links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    now = staged((pairs if contracted else pairs.mapInArrow(_contracted, "u long, v long")).distinct(), "links")
    seen, checksum = None, (F.count("*"), F.expr("bit_xor(xxhash64(u, v))"))
    state = now.agg(*checksum).first()
    for _ in range(max_rounds):
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = staged(with_sums(both, least, ["u"], 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        unstage(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        with_least = with_sums(large, least, ["u"], 2 * state[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = staged(with_least.select("e.u", "e.v").where("u <> v").distinct(), "links")
        unstage(large)
        state = now.agg(*checksum).first()
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
