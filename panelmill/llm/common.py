"""Helpers shared by the corpus operators: materialisation, grouping, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes the shuffle files of a query once it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="panelmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back; instead_of is a settled table that goes once df is complete.

    Cuts the lineage: what follows survives the loss of executors, and an expensive
    Python pass with several consumers runs once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    # the written table replaces the shuffles it was made by; their files go as soon as it is complete
    had = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if had is None else spark.conf.set(CLEANUP, had)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    if instead_of is not None:
        release(instead_of)
    return out


def release(df: DataFrame) -> None:
    """Remove a settled table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files or rows that df reads, as the optimiser knows them; None where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(sizes) if sizes and max(sizes) < 1 << 60 else None


def scatter_width(spark: SparkSession, df: DataFrame | None = None, per: int = 32 << 20) -> int:
    """Partitions for a keyed hand-over: the session's shuffle width, or more where df reads over `per` bytes a partition."""
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = input_bytes(df) if df is not None else None
    return wide if read is None else max(wide, -(-read // per))


def deal(df: DataFrame, keys: list[str], order: list[str], wide: int) -> DataFrame:
    """Rows of equal keys in one task, sorted by keys and order.

    Dealt by a hash of the keys: a plain repartition by the keys of a join before it is taken to be done already, and if adaptive
    execution then splits that join, or makes it a broadcast that reads its shuffle locally, rows of equal keys are parted.
    """
    return df.repartition(wide, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Split a stream of frames sorted by keys into one frame for each run of equal keys."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if pdf.empty:
            continue
        part = pd.DataFrame({k: pdf[k].astype(object).where(pdf[k].notna(), None) for k in keys}).to_numpy()
        change = np.ones(len(pdf), bool)
        change[1:] = (part[1:] != part[:-1]).any(axis=1)
        cuts = [*np.flatnonzero(change).tolist(), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(part[lo])
            piece = pdf.iloc[lo:hi]
            if held and key != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(piece)
            last = key
    if held:
        yield pd.concat(held, ignore_index=True)


#: Lists that a node's neighbours are dealt to, so that no task gets all neighbours of a hub.
HUB_LISTS = 256


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node, root the smallest node reachable.

    Alternates the large-star and small-star steps. A node's neighbours travel in lists dealt by node and hash, so a hub
    is some lists in many tasks and joins its minimum, which is combined before the shuffle, a few hundred times at most. Every
    round is written to the shared folder and replaces the one before. Nulls and self-loops in edges are ignored; an empty
    input gives an empty result.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.where(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    def star(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Lists of b for each a with the least of them all, and that least."""
        lists = df.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(HUB_LISTS)).alias("list")).agg(F.collect_list("b").alias("bs"))
        least = lists.groupBy("a").agg(F.min(F.array_min("bs")).alias("m"))
        return lists.join(least, "a"), least

    now = settle(tidy(edges.select("a", "b").dropna()))
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lists, _least = star(both)
        larger = F.explode(F.filter("bs", lambda b: b > F.col("a")))
        large = tidy(lists.select(larger.alias("a"), F.least("a", "m").alias("b")))
        lists, least = star(large)
        small = lists.select(F.explode("bs").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = settle(tidy(small), now)
        after = mark(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """At most n - 1 pairs that connect what the pairs (i, j) connect."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading columns (integers) in sorted batches, over the batches' borders; one run is in memory."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(keys[lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def blocks(rows: DataFrame, key: str, n: str, block: int) -> DataFrame:
    """Adds the pairs of parts (i <= j) that a row of a group of n rows belongs to, and its own part.

    A group of at most `block` rows is one part; a larger one is split by hash, and each pair of parts is a block of
    its own, so no task gets a whole large group.
    """
    parts = F.ceil(F.col(n) / F.lit(float(block))).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", key), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    return rows.withColumn("other", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")
