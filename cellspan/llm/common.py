"""Helpers shared by the text operators: durable tables, Arrow slicing, folds."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one output batch of a Python operator is made from.
SLICE_BYTES = 4 << 20
#: Largest object that any operator ships to every task.
BROADCAST_BYTES = 64 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster whose machines don't share that folder gets it by ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    if spark.conf.get(BATCH_ROWS) == "10000":
        # the default; whole texts are long, and a batch is held on both sides
        spark.conf.set(BATCH_ROWS, "1000")
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Set here only where the session has none, and only
    on one machine: a cluster has to name a folder that all of its machines see."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        have = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut by a table that outlives any executor, so a lost executor
    costs the tasks it ran and not the stages before.  Shuffle files of the write go
    as it ends: nothing reads them once the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
        give_back()
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete a table of :func:`durable` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def crc_mod(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


#: What operators keep in a worker from task to task, by operator.
WORKER_TABLES: dict[str, dict] = {}


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes of text.

    A row is never cut: one text above the limit travels alone.  After the last batch the
    worker, which other tasks will use again, gives the memory it has freed back.  What
    operators other than ``keep`` have left in the worker goes as the first batch comes.
    """
    for name, tables in WORKER_TABLES.items():
        if name != keep and tables:
            tables.clear()
            gc.collect()
            give_back()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
        del batch
    give_back()


def give_back() -> None:
    """Return memory that this process has freed but still holds to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Let the driver drop what earlier steps left: plans, generated classes, shuffle files.

    They go at a full collection only.  What the compiler and the many short jobs have freed
    outside the heap goes back to the machine where the JVM has a command for it.
    """
    gc.collect()
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    jvm.System.gc()
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # the server's own class is not open to calls, its interface is
    calls = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()}

    def ask(method: str, *values):
        args = gateway.new_array(jvm.java.lang.Object, len(values))
        for i, v in enumerate(values):
            args[i] = v
        return calls[method].invoke(server, args)

    commands, trim = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    if ask("isRegistered", commands) and any(o.getName() == trim for o in ask("getMBeanInfo", commands).getOperations()):
        ask("invoke", commands, trim, None, None)
    give_back()


def int_lists(parts: list) -> pa.Array:
    """A list<int32> column from numpy int32 arrays."""
    import numpy as np

    ends = np.zeros(len(parts) + 1, np.int32)
    if parts:
        np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32, copy=False)))
