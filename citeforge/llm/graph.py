"""Links to components, and buckets compared in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links up to which one task joins them (16 bytes each); more are joined by star contraction.
SMALL_LINKS = 1_000_000
#: Links that a task contracts at a time.
FLUSH_LINKS = 500_000
#: Hot keys that are broadcast at most (some tens of bytes each).
MAX_HOT = 50_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]

    def batch(self) -> pa.RecordBatch:
        links = self.links()
        return pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["u", "v"])


def _contract(batches: Iterable[pa.RecordBatch], flush: float = FLUSH_LINKS) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a task by spanning forests of them: (member, smallest member), a new forest after `flush` nodes."""

    f = Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f.join(u, v)
        if len(f.up) > flush:
            yield f.batch()
            f = Forest()
    yield f.batch()


def _join_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One forest of all links, for the last pass: nothing merges the forests after it. At most 2 * SMALL_LINKS nodes."""
    return _contract(batches, float("inf"))


def _sign(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, small: int = SMALL_LINKS, contracted: bool = False) -> DataFrame:
    """u, v (long) -> node, root: every node that has a link, with the smallest node it reaches.

    Each task first contracts its own links, unless they are so already. Few that are left are joined by one task; more by
    rounds of large-star and small-star until nothing changes (O(log^2 n) rounds), all with
    joins that can be split at a hot node and partial minima.
    """
    e = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = written(e if contracted else e.mapInArrow(_contract, "u long, v long"), "links")  # one Python worker a task is enough
    if e.count() <= small:
        e = e.coalesce(1).mapInArrow(_join_all, "u long, v long")
    else:
        before = None
        while (now := _sign(e)) != before:
            before = now
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            high = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = high.groupBy("u").agg(F.min("v").alias("m"))
            small_star = high.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
            e = written(small_star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return written(nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct()), "roots")


def tiles(rows: DataFrame, keys: list[str], member: Column, block: int, weight: Column | None = None) -> DataFrame:
    """Rows with tile_i, tile_j and part, for comparing the rows of a key in blocks.

    A key of at most `block` rows is one tile (0, 0). A larger one is cut into parts by a hash
    of the member; a row goes to the tile of its part with each other part, so that each pair of
    rows meets in exactly one tile in which their parts are tile_i and tile_j. There are at most
    rows / block such keys; they are broadcast only if they are MAX_HOT at most, else joined.
    With a weight (long), block bounds the sum of the weights instead.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    hot = written(rows.groupBy(*keys).agg(size.alias("key_rows")).where(F.col("key_rows") > block), "hot")
    few = hot.count() <= MAX_HOT
    parts = F.coalesce(F.ceil(F.col("key_rows") / F.lit(block)).cast("int"), F.lit(1))
    out = rows.join(F.broadcast(hot) if few else hot, keys, "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(member), F.col("parts").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return out.withColumn("other", other).withColumn("tile_i", F.least("part", "other")).withColumn("tile_j", F.greatest("part", "other")).drop("key_rows", "parts", "other")


def runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys; the rows come sorted by them, and a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch) - 1, bool)
        for c in keys:
            col = batch.column(c)
            changed |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(batch.column(c)[a].as_py() for c in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
