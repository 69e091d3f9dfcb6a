"""What the operators of this package share: the shared folder, written tables, ordered running sums, components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a word is, everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a one-row-per-key table may be broadcast; above it, joins shuffle.
BROADCAST_ROWS = 50_000
#: Links for which components() takes another task.
LINKS_PER_TASK = 20_000
#: Free part of the driver's heap, in hundredths, that its JVM keeps after a collection.
FREE = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "25"}
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and keeps Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; a temporary one only where that is unset and all is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_veil_dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = spark._veil_dir = "file://" + tempfile.mkdtemp(prefix="veil-")
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str = "zstd", options: dict | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and returns the table: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veil-{tag}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing reads any more."""
    path = getattr(df, "_veil_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Gives back what the driver no longer needs: shuffles, broadcasts and plans that only garbage holds, freed native memory.

    Spark drops shuffle files and broadcasts once the driver's JVM has collected what stands for them, which may not
    come about by itself while its heap has room; and a heap that grew between two collections stays with the JVM,
    which is told to keep little that is free.
    """
    gc.collect()
    jvm = spark._jvm
    try:  # of this JVM's flags these may be set while it runs; others keep what they have
        bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        for flag, value in FREE.items():
            bean.setVMOption(flag, value)
    except Py4JError:
        pass
    jvm.System.gc()
    try:  # memory that compilers and codecs freed; JVMs without this command keep it
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", None, None)
    except Py4JError:
        pass


def n_words(text) ->"F.Column":
    """Number of words of a text column; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _carry(values: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        total = np.zeros(len(values), np.int64)
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            cols.append(pa.array(np.full(b.num_rows, pid, np.int32)))
            for i, name in enumerate(values):
                v = b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)
                before = total[i] + np.cumsum(v) - v
                total[i] += v.sum()
                cols.append(pa.array(before))
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "part", *(f"before_{v}" for v in values)])

    return run


def ordered_before(df: DataFrame, order: Sequence, values: Sequence[str], tag: str) -> DataFrame:
    """Adds before_<v> for each bigint column v: the sum of v over all rows that precede in the order.

    Rows are dealt by ranges of the order and sorted there; each task adds up its own run, and only one total per
    task goes to the driver, so no task and no driver ever holds an ordered group. Ties share no order of their own;
    put a unique column last.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), *(T.StructField(f"before_{v}", T.LongType()) for v in values)])
    run = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_carry(values), schema), tag)
    sums = run.groupBy("part").agg(*(F.sum(v).alias(v) for v in values)).orderBy("part").collect()
    base, rows = [0] * len(values), []
    for r in sums:
        rows.append((r["part"], *base))
        base = [b + r[v] for b, v in zip(base, values)]
    names = [f"base_{v}" for v in values]
    offsets = spark.createDataFrame(rows, T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names)]))
    # one row per task of the sort: bounded by the number of partitions, not by the data
    out = run.join(F.broadcast(offsets), "part")
    for v, n in zip(values, names):
        out = out.withColumn(f"before_{v}", F.col(f"before_{v}") + F.col(n))
    return out.drop("part", *names)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the table is known to have few rows, else the table as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(links: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of links(a, b): returns (node, component), component = smallest node reachable.

    Alternating large-star and small-star steps; every step is a map-side combined minimum and one join, and each
    round is cut by a written table. Nodes without links don't occur. Null ends are dropped.
    """
    spark = links.sparkSession
    width = spark.conf.get("spark.sql.shuffle.partitions")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = materialize(edges, tag)
    try:  # rounds over few links need few tasks
        spark.conf.set("spark.sql.shuffle.partitions", str(max(1, min(int(width), -(-edges.count() // LINKS_PER_TASK)))))
        return _rounds(edges, tag)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def _rounds(edges: DataFrame, tag: str) -> DataFrame:
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(star, tag)
        discard(edges)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link, to a smaller node that has none of its own: then that is its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.where("out > 1 or (out > 0 and into > 0)").limit(1).count() == 0
