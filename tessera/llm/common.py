"""Helpers that the operators share: shared storage, size-checked joins, gapless numbering, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import storage
from tessera.shipping import on_workers

#: A side of a join is broadcast only if its stored files are no larger than this.
BROADCAST_BYTES = 8 << 20

#: Blocks of a numbering whose starts one task adds up.
BLOCKS_AT_ONCE = 1 << 16

#: Links that a task reduces to a forest at once.
FOREST_LINKS = 1 << 18

#: Fewer rows are not worth a shuffle to have more tasks.
ROWS_WORTH_DEALING = 512


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the given folder, only the named columns."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found.select(*columns) if columns else found


class Scratch:
    """Tables written in the shared folder, which cut lineage and outlive executors.

    They are deleted by ``drop`` or, at the latest, when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        on_workers(spark)
        self.spark = spark
        self.root = storage.new_folder(spark, name)
        self.made = 0

    def keep(self, frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """The frame, written once and read back; with ``by`` in a folder for each value of some columns."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        back = storage.stored(frame, path, by)
        back._kept_at = path  # noqa: SLF001
        return back

    def bytes(self, kept: DataFrame) -> int:
        """Size of the files of a kept frame."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept._kept_at)
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return system.getContentSummary(where).getLength()

    def small(self, kept: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
        """The kept frame, marked for broadcast if its files are within the limit, else as it is."""
        return F.broadcast(kept) if self.bytes(kept) <= limit else kept

    def drop(self, kept: DataFrame) -> None:
        """Delete a kept frame that nothing reads any more."""
        storage.delete(self.spark, kept._kept_at)


def spread(frame: DataFrame) -> DataFrame:
    """The frame, dealt to all cores where its files leave most of them idle.

    Files with few or uneven row groups give few tasks that have rows. Only frames of a few partitions a core are looked
    at, by counting their rows; larger ones keep all cores busy as they are.
    """
    context = frame.sparkSession.sparkContext
    cores = context.defaultParallelism
    if frame.select().rdd.getNumPartitions() > 4 * cores:
        return frame
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    if sum(sizes) < ROWS_WORTH_DEALING or max(sizes) * cores <= 3 * sum(sizes):
        return frame
    return frame.repartition(2 * cores)


def bucket(columns: Sequence[str | Column], count: int) -> Column:
    """A stable number from 0 to count - 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def gapless(
    frame: DataFrame, groups: Sequence[str], order: Sequence[str], out: str, blocks: int
) -> DataFrame:
    """Adds the gapless index (from 0) of each row inside its group.

    Rows are dealt by a hash of the order columns to ``blocks`` blocks a group, numbered inside each, and shifted by the
    rows of the blocks before; so a group with most of the rows is still spread over many tasks. ``groups`` must hold no
    nulls. The order of a group is (block, order columns). The starts of the blocks of a group are added up by one task up
    to BLOCKS_AT_ONCE of them; more are added up in two levels, lots of blocks and then the lots.
    """
    dealt = frame.withColumn("__block", bucket(order, blocks))
    key = [*groups, "__block"]
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    sums = lambda columns, by, n: F.coalesce(
        F.sum(n).over(Window.partitionBy(*columns).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    if blocks <= BLOCKS_AT_ONCE:
        starts = sizes.select(*key, sums(groups, "__block", "__n").alias("__start"))
    else:
        lot = [*groups, "__lot"]
        parted = sizes.withColumn("__lot", F.floor(F.col("__block") / BLOCKS_AT_ONCE))
        lots = parted.groupBy(*lot).agg(F.sum("__n").alias("__m")).select(*lot, sums(groups, "__lot", "__m").alias("__before"))
        inner = parted.select(*lot, "__block", sums(lot, "__block", "__n").alias("__inner"))
        starts = inner.join(lots, lot).select(*key, (F.col("__before") + F.col("__inner")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return (
        dealt.withColumn("__inside", inside)
        .join(starts, key)
        .withColumn(out, (F.col("__start") + F.col("__inside") - 1).cast("long"))
        .drop("__block", "__start", "__inside")
    )


def roots_of(count: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each member's component."""
    root = np.arange(count)
    if not pairs:
        return root
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def stars_of(nodes: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member that isn't its component's root, with the root."""
    at = np.flatnonzero(root != np.arange(len(root)))
    return nodes[at], nodes[root[at]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each lot of links (u, v) a star for each of its components: as many links as join the same nodes, no more."""

    def reduced(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([b.column(k).to_numpy() for k in range(2) for b in lot])
        nodes, place = np.unique(ends, return_inverse=True)
        u, v = stars_of(nodes, roots_of(len(nodes), [tuple(np.split(place, 2))]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    lot, held = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, FOREST_LINKS):
            part = batch.slice(start, FOREST_LINKS)
            if held + part.num_rows > FOREST_LINKS:
                yield reduced(lot)
                lot, held = [], 0
            lot.append(part)
            held += part.num_rows
    if lot:
        yield reduced(lot)


def components(scratch: Scratch, links: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of links: one row (node, component) per linked node, component the smallest node.

    Alternates large-star and small-star rounds (each joins a node's larger, then its smaller neighbours to the smallest
    of them) until no link changes. Each round is written to the shared folder; nothing but two sums goes to the driver.
    So are the smallest neighbours: a node with very many neighbours then meets its own in a plain join of two tables,
    which Spark splits where it is skewed. And so is what the large-star step makes, which is read twice.

    Links that say again what others say, as of a large group whose members met in many places, go before the first
    round: a node's links come together, and each task leaves a forest of its own. Any dealing of the links would do, so
    a node with very many is split.
    """
    edges = links.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v")).where("u <> v")
    edges = scratch.keep(edges.hint("rebalance", F.col("u")).mapInArrow(_forest, "u long, v long"))
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u <> v").distinct())
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = scratch.keep(small)
        scratch.drop(edges)
        scratch.drop(least)
        scratch.drop(large)
        edges = after
        now = tuple(edges.agg(F.count(F.lit(1)), total).first())
        if now == mark or now[0] == 0:
            break
        mark = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
