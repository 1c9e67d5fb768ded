"""Shared helpers of the training-data operators: tables, shared storage, checkpoints, graph components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import ship

#: Rows up to which a counted table of narrow rows may be broadcast (about 16 MB of digests and ids).
BROADCAST_ROWS = 200_000
#: Pointer jumps of a round of components.
JUMPS = 3
#: Links up to which one task ends the components (about 3 MB), whatever the size of the graph that was contracted to them.
LINKS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where nothing is named, a temporary one
    if driver and executors are one process, and a failure on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder and go on from there (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark clear the files of shuffles and checkpoints that no plan refers to any more, as it does after a collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def collect_on_executors(spark: SparkSession, tasks: int) -> None:
    """A full collection of garbage in the JVM of each task, after which it returns the part of its heap that is not used."""
    collect = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, tasks, 1, tasks).select(collect.alias("done")).write.format("noop").mode("overwrite").save()


def give_back(spark: SparkSession) -> None:
    """Clear what no plan refers to any more, and let executors return the heap that earlier steps filled: a JVM keeps it otherwise,
    beside the Python workers of the next step. A task for each core reaches all executors; in local mode tidy has reached the only JVM."""
    tidy(spark)
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        collect_on_executors(spark, spark.sparkContext.defaultParallelism)


def sliced(batches, rows: int = 256):
    """The batches in slices of a few rows, so that a Python worker holds few texts at a time; then gives memory back."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are few, else as it is (a shuffled join then)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links between u and v, sorted, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return nodes, nodes[root]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: one row (node, root) per linked node, root the smallest node reachable.

    Contraction by smallest neighbours: each round maps every node to the smallest node next to it, follows
    that a few steps on, and draws the links between the images, so the graph shrinks geometrically. Hubs are safe: a round is one
    partially aggregated minimum and joins on single nodes. A graph of few links (LINKS) is ended by one task: its rounds would be
    jobs of hundreds of nearly empty tasks, with a file for each. Null ends are ignored; no links give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    reps = None
    while e.count() > 2 * LINKS:
        if reps is None:
            reps = e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
        m = cut(e.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        # Three jumps follow eight steps down, so that even a chain of rising ids shrinks eightfold in a round.
        for _ in range(JUMPS):
            onward = m.select(F.col("u").alias("m"), F.col("m").alias("further"))
            m = m.join(onward, "m", "left").select("u", F.coalesce("further", "m").alias("m"))
        m = cut(m)
        reps = cut(
            reps.join(m.select(F.col("u").alias("root"), "m"), "root", "left")
            .select("node", F.coalesce("m", "root").alias("root"))
        )
        mu, mv = m.select("u", F.col("m").alias("mu")), m.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        e = cut(
            e.join(mu, "u").join(mv, "v").where("mu <> mv").select(F.col("mu").alias("u"), F.col("mv").alias("v")).distinct()
        )

    def run(batches):
        ends = [(np.zeros(0, np.int64),) * 2, *((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)]
        nodes, roots = joined(*map(np.concatenate, zip(*ends)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    last = cut(e.where("u < v").coalesce(1).mapInArrow(run, "node long, root long"))
    if reps is None:
        return last
    onward = F.broadcast(last.select(F.col("node").alias("root"), F.col("root").alias("m")))
    return cut(reps.join(onward, "root", "left").select("node", F.coalesce("m", "root").alias("root")))
