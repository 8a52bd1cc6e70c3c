"""Embedding near-dedup by spherical-cap filters.

A vector is turned by a random rotation and cut into BLOCKS blocks; a filter direction joins one
random code word of each block (a product code), so its score is the sum of a few table entries.
List decoding files a vector under every filter whose score exceeds a threshold, and under its LEAST
best ones in any case. The size of the code follows the largest label (plan): so many filters that one holds
LOAD vectors of it if they lie evenly, and the threshold at which a vector passes MANY of them. A vector is then
compared with some LOAD * MANY others, however many there are. Vectors of one label that share a filter are
compared by cosine in double precision. A pair counts at the first filter it shares, so each link counts once,
though pairs are never written: a task returns link counts and a spanning forest. Filters of more than BLOCK
vectors are compared in blocks.

Exact copies (same label and components) are one member with a weight. Vectors that are null,
empty, zero or hold null or non-finite components, and rows without label or vec_id, link with
nothing: n_links 0, themselves their component. Different dimensions never link. A vector is scaled by its
largest component first, so tiny and huge ones keep their direction. Repeated rows are vectors of their own; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .common import spread, table, written
from .graph import Forest, components, runs, tiles

COSINE, BLOCKS, LOAD, MANY, LEAST, BLOCK, RNG = 0.93, 2, 64, 24, 20, 1024, 20


def plan(largest: int) -> int:
    """Code words of a block for a largest label of so many vectors; one filter for all where that is its load."""
    return 1 if largest <= LOAD else int(np.ceil((MANY * largest / LOAD) ** (1 / BLOCKS)))


class ProductCode:
    """Filters for one dimension; the same in every task, as they come from a fixed seed."""

    def __init__(self, dim: int, codewords: int, seed: int = RNG) -> None:
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), min(BLOCKS, dim))
        words = [rng.normal(size=(codewords, len(c))) for c in self.cuts]
        self.words = [w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(len(self.cuts)) for w in words]
        self.size = codewords ** len(self.cuts)
        # the score of a random direction is near normal with variance 1 / dim
        self.threshold = float(NormalDist().inv_cdf(1 - MANY / self.size) / np.sqrt(dim)) if self.size > MANY else -2.0

    def decode(self, unit: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
        """Sorted filters of each unit vector."""
        turned = unit @ self.turn
        tables = [turned[:, c] @ w.T for c, w in zip(self.cuts, self.words, strict=True)]
        orders = [np.argsort(-t, axis=1) for t in tables]
        sorted_ = [np.take_along_axis(t, o, axis=1) for t, o in zip(tables, orders, strict=True)]
        out = []
        for i in range(len(unit)):
            found, score = orders[0][i].astype(np.int64), sorted_[0][i]
            for order, more in zip(orders[1:], sorted_[1:], strict=True):
                # the best `least` sums take words of the best `least` of each block
                few = np.sort((score[:least, None] + more[i, None, :least]).ravel())
                limit = min(self.threshold, float(few[-min(least, len(few))]))
                many = np.searchsorted(-more[i], score - limit, side="right")
                found = np.repeat(found, many) * more.shape[1] + order[i][np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            out.append(np.sort(found))
        return out


_codes: dict[tuple[int, int], ProductCode] = {}


def code(dim: int, codewords: int) -> ProductCode:
    if (dim, codewords) not in _codes:
        _codes[dim, codewords] = ProductCode(dim, codewords)
    return _codes[dim, codewords]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _file(kind: str, codewords: int):
    """A row for each vector and filter. kind: the vectors' numpy type in the packed binary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(kind).itemsize
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                vectors = batch.column("vector").to_pylist()
                rows: list[list] = [[], [], []]
                for dim in {len(v) // size for v in vectors}:
                    idx = [i for i, v in enumerate(vectors) if len(v) == size * dim]
                    x = np.frombuffer(b"".join(vectors[i] for i in idx), kind).reshape(-1, dim).astype(np.float64)
                    for i, filters in zip(idx, code(dim, codewords).decode(_unit(x)), strict=True):
                        rows[0] += [i] * len(filters)
                        rows[1] += filters.tolist()
                        rows[2] += [filters.tobytes()] * len(filters)
                take = batch.take(pa.array(rows[0], pa.int32()))
                yield pa.record_batch([*take.columns, pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=[*take.schema.names, "filter", "filters"])

    return run


TILE = ("label", "dim", "filter", "tile_i", "tile_j")


def _compare(least_cosine: float, kind: str):
    def tile(t: pa.Table, out: list[list]) -> None:
        own, i, j = (t.column(c)[0].as_py() for c in ("filter", "tile_i", "tile_j"))
        node, weight, part = (t.column(c).to_numpy() for c in ("node", "weight", "part"))
        unit = _unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(len(node), -1).astype(np.float64))
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        counts, forest, bits = np.zeros(len(node), np.int64), Forest(), None
        for s in range(0, len(left), 128):
            rows = left[s : s + 128]
            a, b = np.nonzero(unit[rows] @ unit[right].T >= least_cosine)
            a, b = rows[a], right[b]
            keep = (a < b) if i == j else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            if len(a) and bits is None:  # filters of each vector before this one
                held = [np.frombuffer(f, np.int64) for f in t.column("filters").to_pylist()]
                held = [f[f < own] for f in held]
                kinds, places = np.unique(np.concatenate(held), return_inverse=True)
                bits = np.zeros((len(node), len(kinds) // 8 + 1), np.uint8)
                np.bitwise_or.at(bits, (np.repeat(np.arange(len(node)), [len(f) for f in held]), places >> 3), (1 << (places & 7)).astype(np.uint8))
            for c in range(0, len(a), 1 << 14):
                x, y = a[c : c + (1 << 14)], b[c : c + (1 << 14)]
                first = ~(bits[x] & bits[y]).any(axis=1)
                x, y = x[first], y[first]
                np.add.at(counts, x, weight[y])
                np.add.at(counts, y, weight[x])
                for u, v in zip(node[x].tolist(), node[y].tolist(), strict=True):
                    forest.join(u, v)
        for k in np.flatnonzero(counts):
            out[0].append(int(node[k]))
            out[1].append(None)
            out[2].append(int(counts[k]))
        for u, v in forest.links():
            out[0].append(u)
            out[1].append(v)
            out[2].append(0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda out: pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["u", "v", "n"])
        out: list[list] = [[], [], []]
        for t in runs(batches, TILE):
            if len(t) > 1:
                tile(t, out)
            if len(out[0]) > 50_000:
                yield shown(out)
                out = [[], [], []]
        yield shown(out)

    return run


def cap_groups(rows: DataFrame, least_cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, embedding, label -> vec_id, n_links, component_id, kept: one row a vector."""
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    usable &= F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    all_rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("vector"))
    # adding 0 makes -0.0 and 0.0 one
    all_rows = all_rows.withColumn("usable", usable).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    keyed = written(all_rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "vector"))), "vectors")
    members = keyed.where("usable").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    members = written(members, "members")
    kind = "<f4" if rows.schema["embedding"].dataType == ST.ArrayType(ST.FloatType()) else "<f8"  # what the input's numbers fit in
    packed = members.select("node", "weight", "label", _pack("vector", kind).alias("vector"))
    largest = members.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    filed = spread(packed, MANY).mapInArrow(_file(kind, plan(largest)), "node long, weight long, label string, vector binary, filter long, filters binary").withColumn("dim", F.length("vector"))
    tiled = tiles(filed, ["label", "dim", "filter"], F.col("node"), block).repartition(*TILE).sortWithinPartitions(*TILE)
    found = written(tiled.mapInArrow(_compare(least_cosine, kind), "u long, v long, n long"), "cap-links")
    counts = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("v is not null").select("u", "v"))
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").join(counts, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "node").join(named, "node", "left")
    whole = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"), F.coalesce(F.col("vec_id") == whole, F.lit(False)).alias("kept"))


def _pack(col: str, kind: str):
    """array<double> as little-endian binary, so that a shuffled row is one compact value."""

    @F.pandas_udf("binary")
    def pack(s):
        return s.map(lambda v: np.asarray(v, kind).tobytes())

    return pack(F.col(col))


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_groups(table(spark, sf_dir, "embeddings"))
