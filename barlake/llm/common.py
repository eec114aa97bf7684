"""What the training-data operators share: tables, spooled intermediates, grouped batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.scratch import shared_dir

#: Words are what stands between these characters.
SPACES = "[ \\t\\n\\x0B\\f\\r]"
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def spool(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there,
    and a lost executor costs at most a re-read."""
    path = f"{shared_dir(df.sparkSession)}/spool-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def laid_out(df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` to the shared folder as a table in buckets of ``key`` and read it back: joins on it move only
    their other side. The table is named in the session's catalogue until free()."""
    spark = df.sparkSession
    name = f"barlake_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._spooled, out._table = path, name
    return out


def free(*frames: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for df in frames:
        if hasattr(df, "_table"):
            df.sparkSession.sql(f"drop table if exists {df._table}")
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._spooled)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold few rows, so that they fit a Python worker; a number that the caller
    has set stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def by_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str, rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (the last may be shorter) that never split a run of
    equal ``keys``; the input is sorted by them. Memory: ``rows`` and the longest run."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cols = [np.asarray(t.column(k)) for k in keys]
        change = np.zeros(len(t) - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held = t.to_batches()
            continue
        at = int(cuts[-1]) + 1
        yield t.slice(0, at)
        held = t.slice(at).combine_chunks().to_batches()
        n = len(t) - at
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to a spanning forest: each node but the smallest of its component, with that one."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        if (lx == ly).all():
            break
        low = np.minimum(lx, ly)
        np.minimum.at(label, lx, low)
        np.minimum.at(label, ly, low)
        while (label[label] != label).any():
            label = label[label]
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over undirected ``edges`` (a, b, both long).

    Alternating large-star and small-star steps; each step's minimum per node is written out, so
    that the join with it is one of two plain tables, which Spark can split at a hot node. Ends
    when a round changes nothing. Nodes without an edge are not returned.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = spool(e.groupBy("a").agg(F.min("b").alias("low")))
        low = low.select("a", F.least("a", "low").alias("low"))
        j = e.join(low, "a")
        if large:
            out = j.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = j.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = spool(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = mark(now)
    while seen[0]:
        big = spool(star(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        after = spool(star(big, False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        free(now, big)
        now, last, seen = after, seen, mark(after)
        if seen == last:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return spool(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots))
