"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch of texts at most: a row may be very long.
TEXT_ROWS, TEXT_BYTES = 500, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a fresh one on a single
    machine, as in tests; on a cluster that is an error, for executors wouldn't see each other's files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, executors may go.

    Tables that nothing reads any more are deleted by ``discard``; those that a result reads stay, until whoever runs
    the job empties the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession) -> None:
    """Have the driver, its JVM and its Python, collect garbage and hand free memory to the machine. What finished plans
    hold, their broadcasts and shuffle files too, goes only then, and the heap grows to its limit before the JVM does so by
    itself. Beside the heap, hundreds of threads that plan and compile leave freed memory in their parts of malloc."""
    gc.collect()
    tidy()
    spark._jvm.System.gc()
    try:
        _trim(spark)
    except (Py4JError, TypeError):
        pass  # not every JVM has the command


def _trim(spark: SparkSession) -> None:
    """The JVM's ``System.trim_native_heap``. By reflection, for the server's own class is closed to Py4J."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    kinds = [of(c) for c in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    args = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new(jvm.Object, 0), new(jvm.String, 0)]
    types, values = new(jvm.java.lang.Class, 4), new(jvm.Object, 4)
    for i in range(4):
        types[i], values[i] = kinds[i], args[i]
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    of("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values)


def text_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small batches, by rows and by bytes. Spark reads these settings when a plan runs, so they
    stay lowered in the session; values that are lower already are left."""
    for key, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.match(r"(-?\d+)b?$", spark.conf.get(key, str(most)))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def tidied(run):
    """A function over batches that gives memory back to the machine at its end: a worker lives on, and what its tasks
    have taken at most adds up over the workers of a machine."""

    def wrapped(batches):
        yield from run(batches)
        tidy()

    return wrapped


def tidy() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected link table, by alternating large-star and small-star rounds.

    Returns ``node, root`` for every node with a link to another, ``root`` the least node of its component. Each
    round is two equi-joins with pre-aggregated minima, written to the shared folder; only a count and a checksum
    come to the driver. Rows of a node with very many links are split by Spark's handling of skewed joins. Nodes may be numbers or strings; null ends and self links are dropped, repeats do no harm.
    An empty table gives an empty table.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialize(e, "links")
    seen = _mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.where("u <> v").distinct(), "links")
        discard(old)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


#: Keys that are broadcast by ``join_counted`` at most: those that more than one in so many rows have.
HOT_KEYS = 1_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, most: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key and in ``n`` how many of the ``total`` rows have it.

    Hot keys, those of more than one in ``most`` rows, are fewer than ``most``: their table rows are broadcast, so that
    rows of a hot key stay where they are. The others meet in a shuffle; none of these is a large share of a task's.
    ``table`` is read three times, so it is written first unless it has been: plans that repeat what makes it take a
    thread and memory of the driver for each exchange in them."""
    if not hasattr(table, "_table_path"):
        table = materialize(table, "counted-keys")
    hot, other = table.where(F.col(n) * most > total).drop(n), table.where(F.col(n) * most <= total).drop(n)
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(other, key)
    return often.unionByName(seldom)
