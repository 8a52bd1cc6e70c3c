"""SimHash near-duplicates by multi-index hashing.

Fingerprints: bit b of a document is 1 if it is set in over half of the XXH64 values (seed 42)
of its word shingles. Search: the fingerprint is cut into a 32-bit high and a 32-bit low
segment. Two fingerprints that differ in at most two bits differ in at most one bit of the high
segment, or not at all in the low one. So each distinct fingerprint is filed in the Hamming ball
of radius 1 of its high segment, by the 32 keys that mask one bit, and under its low segment; the
members of a table entry are compared by their complete distance. Entries of more than BLOCK members are compared in blocks; a task
returns a spanning forest of the links it finds, never all pairs.

The wide form (one_of_each_group) is for five-word shingles at a similarity of 0.8: there two
fingerprints differ in about a seventh of their bits, which no small ball of a 64-bit fingerprint
reaches, so it takes 512 bits or more and many tables of segments (see wide_plan); the groups that
it proposes are compared by the shingles themselves.

Exact copies share a fingerprint and are one member. Null or wordless text: fingerprint 0, linked
like any other. A null doc_id is the smallest of no group unless its group has no other.
Repeated rows are separate rows of one group. An empty table gives no row; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, map_slices, spread, table, texts_of, written
from .graph import FLUSH_LINKS, Forest, components, runs, tiles

SEED, SHINGLE, MAX_BITS, BLOCK = 42, 3, 2, 2048
LOW = 0xFFFFFFFF


def shingle_digests(text: str, shingle: int) -> bytes:
    """XXH64 of each shingle of the words (A-Z lowered), big-endian, one after another; b"" without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six spaces of the word pattern
    if not words:
        return b""
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(line, SEED)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    return b"".join([xxhash.xxh64_digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)])


def majority(rows: np.ndarray) -> np.ndarray:
    """Bytes whose bits are set in over half of the rows (uint8, one digest a row)."""
    set_in = np.zeros(8 * rows.shape[1], np.int64)
    for i in range(0, len(rows), 255):  # sums of 255 bits fit in a byte
        set_in += np.unpackbits(rows[i : i + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_in > len(rows))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    digests = shingle_digests(text, shingle)
    return int.from_bytes(majority(np.frombuffer(digests, np.uint8).reshape(-1, 8)).tobytes(), "big") if digests else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.record_batch([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


#: Rows of a table entry from which pairs already joined are skipped.
LONG_RUN = 64


def _join_near(most: int, width: int):
    """Spanning forest of the near pairs in each tile, over rows that come sorted by tile. width: 64-bit words of a fingerprint.

    Short tiles are compared all at once, by distance in the sorted order; in long ones a row is compared with the rows
    that it is not yet joined to, so a group of many near copies costs about a comparison a row, not one a pair.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in ("key", "tile_i", "tile_j", "part", "node", *[f"w{i}" for i in range(width)])]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            n = len(cols[0])
            new = np.ones(n, bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            last = int(np.flatnonzero(new)[-1]) if n else 0  # this tile may go on in the next batch
            compare([c[:last] for c in cols], new[:last], forest)
            held = [c[last:] for c in cols]
            if len(forest.up) > FLUSH_LINKS:
                yield forest.batch()
                forest = Forest()
        if held is not None and len(held[0]):
            compare(held, np.arange(len(held[0])) == 0, forest)
        yield forest.batch()

    def compare(cols: list[np.ndarray], new: np.ndarray, forest: Forest) -> None:
        _, tile_i, tile_j, part, node, *words = cols
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(node)))
        end = np.repeat(starts + sizes, sizes)
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= LONG_RUN), sizes))
        d = 1
        while len(at := at[at + d < end[at]]):
            bits = sum(np.bitwise_count((w[at] ^ w[at + d]).view(np.uint64)).astype(np.uint16) for w in words)
            near = at[(bits <= most) & ((tile_i[at] == tile_j[at]) | (part[at] != part[at + d]))]
            for u, v in zip(node[near].tolist(), node[near + d].tolist(), strict=True):
                forest.join(u, v)
            d += 1
        for k in np.flatnonzero(sizes > LONG_RUN):
            lo, hi = int(starts[k]), int(starts[k] + sizes[k])
            own, parts, same = node[lo:hi], part[lo:hi], tile_i[lo] == tile_j[lo]
            label = np.array([forest.root(x) for x in own.tolist()])
            mine = [w[lo:hi] for w in words]
            for r in range(len(own) - 1):
                rest = np.flatnonzero(label[r + 1 :] != label[r]) + r + 1
                if not same:
                    rest = rest[parts[rest] != parts[r]]
                if not len(rest):
                    continue
                bits = sum(np.bitwise_count((w[rest] ^ w[r]).view(np.uint64)).astype(np.uint16) for w in mine)
                for x in np.unique(label[rest[bits <= most]]).tolist():
                    label[label == x] = label[r]
                    forest.join(int(own[r]), x)

    return run


def _near(rows: DataFrame, most: int, width: int, block: int) -> DataFrame:
    """key, node, w0.. -> u, v: links that connect all nodes that share a key and differ in at most `most` bits."""
    cut = ["key", "tile_i", "tile_j"]
    cols = [*cut, "part", "node", *[f"w{i}" for i in range(width)]]
    tiled = tiles(rows, ["key"], F.col("node"), block).select(*cols).repartition(*cut).sortWithinPartitions(*cut)
    return tiled.mapInArrow(_join_near(most, width), "u long, v long")


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct fp -> u, v: links that connect all fingerprints with at most max_bits (2 or less) differing bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the tables cover at most two differing bits")
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    masked = F.array(*[F.col("high").bitwiseAND(F.lit(LOW ^ (1 << j))) + F.lit(j << 32) for j in range(32)])
    rows = spread(nodes, 33).select("fp", high.alias("high"), low.alias("low"))
    rows = rows.select(F.col("fp").alias("node"), F.col("fp").alias("w0"), F.explode(F.concat(masked, F.array(F.col("low") + F.lit(32 << 32)))).alias("key"))
    return _near(rows, max_bits, 1, block)


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    fps = written(fingerprints(docs, shingle), "fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-nodes")
    roots = components(near_links(nodes.select("fp"), max_bits), contracted=True)
    # only groups of several fingerprints are in roots
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(nodes["fp"], "first", F.coalesce("root", nodes["fp"]).alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: The wide form, for texts that share most of their shingles: tables of segments (balls of radius 0), half of them side by
#: side and half across. Candidates differ in few of the first CHECK_WORDS * 64 bits (CHECK_SIGMAS standard deviations
#: above the mean); their shingles decide.
WIDE_SHINGLE, LEAST_SEGMENT, CHECK_WORDS, CHECK_SIGMAS, SIMILARITY = 5, 16, 4, 3.0, 0.8
#: Members that a table entry has on average at most, and the share of pairs at the similarity that miss all tables.
ENTRY_LOAD, MISSED = 256, 0.01
#: Shingles of a group that are compared as one tile.
BLOCK_SHINGLES = 500_000


def bit_differs(similarity: float) -> float:
    """Share of bits in which sets of this Jaccard similarity differ: the angle of their vectors."""
    return float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def wide_plan(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bits of a segment and 64-bit words of a fingerprint for n documents.

    Segments grow with log n, so that an entry of unlike texts keeps ENTRY_LOAD members; as longer segments agree more
    seldom, there are as many tables as keep the share of missed pairs. Up to 2**24 documents: 16 bits, 64 tables, 512 bits.
    """
    segment = max(LEAST_SEGMENT, int(np.ceil(np.log2(max(n, 1) / ENTRY_LOAD))))
    tables = np.log(MISSED) / np.log1p(-((1 - bit_differs(similarity)) ** segment))
    return segment, max(CHECK_WORDS, -(-int(np.ceil(tables / 2)) * segment // 64))


def shingle_set(text: str, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Distinct digests of the shingles, sorted."""
    return np.unique(np.frombuffer(shingle_digests(text, shingle), ">u8").astype(np.uint64))


def wide_fingerprint(text: str, shingle: int = WIDE_SHINGLE, words: int = 8) -> bytes:
    """Majority bits over each distinct digest and its scrambles; zero bytes without words."""
    h = shingle_set(text, shingle)
    if not len(h):
        return bytes(8 * words)
    out = b""
    for i in range(0, words):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out += majority((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8)).tobytes()
    return out


def table_keys(prints: np.ndarray, segment: int) -> np.ndarray:
    """Keys of fingerprints (rows of bytes): segments side by side, then segments that take a bit of each of the first."""
    bits = np.unpackbits(prints, axis=1)
    half = bits.shape[1] // segment
    beside = bits[:, : half * segment].reshape(len(bits), half, segment)
    across = beside.transpose(0, 2, 1).reshape(len(bits), half, segment)
    power = 1 << np.arange(segment, dtype=np.int64)
    return np.concatenate([beside @ power, across @ power], axis=1) + (np.arange(2 * half, dtype=np.int64) << segment)


def _filed(segment: int):
    """node, fp -> a row for each table: key, node and the words that are compared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                prints = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(len(batch), -1)
                keys = table_keys(prints, segment)
                check = np.ascontiguousarray(prints[:, : 8 * CHECK_WORDS]).view(np.int64)
                many = keys.shape[1]
                again = [np.repeat(x, many) for x in (np.asarray(batch.column("node")), *check.T)]
                yield pa.record_batch([pa.array(keys.ravel()), *map(pa.array, again)], names=["key", "node", *[f"w{i}" for i in range(CHECK_WORDS)]])

    return run


def _near_hub(similarity: float):
    """node, key, shingles, hub (the shingles of the group's hub) -> node, key of the rows alike to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for own, hub in zip(batch.column("shingles"), batch.column("hub"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (own, hub))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-6)
            yield batch.select(["node", "key"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(similarity: float):
    """Spanning forest of the pairs in each tile, one of the left and one of the right, whose shingle sets have this Jaccard similarity.

    Every pair that is not yet joined is looked at; rows that are alike to the hub are joined from the start.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[int] = []
        vs: list[int] = []
        for tile in runs(batches, ("key", "tile_i", "tile_j")):
            n, side, hubbed = (tile.column(c).to_numpy() for c in ("node", "side", "hubbed"))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            names, who = np.unique(n, return_inverse=True)
            group = np.arange(len(names))
            group[who[hubbed == 1]] = -1
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("shingles")]
            sizes = np.array([len(x) for x in sets])
            kinds, at = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(sizes)
            flat = np.concatenate([at[ends[k] - sizes[k] : ends[k]] for k in right])
            first = np.cumsum(sizes[right]) - sizes[right]
            mark = np.zeros(len(kinds), np.int32)
            for k in left:
                apart = group[who[right]] != group[who[k]]
                if not apart.any():
                    continue
                own = at[ends[k] - sizes[k] : ends[k]]
                mark[own] = 1
                both = np.add.reduceat(mark[flat], first)
                mark[own] = 0
                # the slack is far below the step of any fraction and far above its rounding
                for c in right[apart & (both >= similarity * (sizes[k] + sizes[right] - both) - 1e-6)]:
                    if group[who[c]] != group[who[k]]:
                        group[group == group[who[c]]] = group[who[k]]
                        us.append(int(n[k]))
                        vs.append(int(n[c]))
            if len(us) > FLUSH_LINKS:
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def alike_links(sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """node, key (group), n_shingles, shingles -> u, v: links that connect the rows of a group that are alike.

    First all rows of a group are compared with its hub (the row whose node is the key), a group of many near copies being dealt
    over parts of `block` shingles; this joins most of them at one comparison each. Then the rows that are left are
    compared with all rows of their group, in tiles of a part of the one and a part of the others.
    """
    parts = lambda n: F.ceil(F.sum(n) / F.lit(block)).cast("int")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sizes = written(sets.groupBy("key").agg(parts("n_shingles").alias("parts")), "group-sizes")
    sized = sets.join(sizes, "key")
    hubs = sized.where("node = key").select("key", every(F.col("parts")).alias("part"), F.col("shingles").alias("hub"))
    dealt = sized.where("node <> key").withColumn("part", place(F.col("parts"), 0)).join(hubs, ["key", "part"])
    near = written(dealt.select("node", "key", "shingles", "hub").mapInArrow(_near_hub(similarity), "node long, key long"), "near-hub")
    rest = sets.where("node <> key").join(near.select("node"), "node", "left_anti")
    left_parts = written(rest.groupBy("key").agg(parts("n_shingles").alias("left_parts")), "rest-sizes")
    cols = ["key", "tile_i", "tile_j"]
    left = rest.join(left_parts, "key").join(sizes, "key").withColumn("tile_i", place(one("left_parts"), 1)).withColumn("tile_j", every(F.col("parts")))
    right = sets.join(left_parts, "key").join(sizes, "key").join(near.select("node", F.lit(1).alias("hubbed")), "node", "left")
    right = right.withColumn("hubbed", F.greatest(F.coalesce("hubbed", F.lit(0)), (F.col("node") == F.col("key")).cast("int"))).withColumn("tile_j", place(F.col("parts"), 2)).withColumn("tile_i", every(one("left_parts")))
    rows = left.select(*cols, "node", F.lit(0).alias("side"), F.lit(0).alias("hubbed"), "shingles").unionByName(right.select(*cols, "node", F.lit(1).alias("side"), "hubbed", "shingles"))
    tiled = rows.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(_alike(similarity), "u long, v long")
    return near.select(F.col("node").alias("u"), F.col("key").alias("v")).unionByName(tiled)


def one_of_each_group(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents without exact and near copies: of each group the one of the smallest doc_id stays (null ids last).

    Of equal ids the row with the smallest hash of all its columns stays, so reruns agree; of wholly equal rows one.
    Texts without words are one group. Fingerprints only propose groups; within each, all pairs are compared by their
    shingles. Rows are told apart by 128 bits. No column name is reserved.
    """
    segment, words = wide_plan(docs.count(), similarity)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [wide_fingerprint(t, words=words) for t in texts_of(batch)]
        return pa.record_batch([batch.column("doc_id"), batch.column("r1"), batch.column("r2"), pa.array(prints, pa.binary())], names=["doc_id", "r1", "r2", "fp"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in texts_of(batch)]
        return pa.record_batch([batch.column("r1"), batch.column("r2"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["r1", "r2", "n_shingles", "shingles"])

    one, two = free_names(docs, "r1", "r2")
    every = [F.col(f"`{c}`") for c in docs.columns]
    base = docs.withColumns({one: F.xxhash64(*every), two: F.xxhash64(F.lit(1), *every)})
    plain = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(one).alias("r1"), F.col(two).alias("r2"), "text")
    fps = written(map_slices(plain, run, "doc_id long, r1 long, r2 long, fp binary").withColumn("node", F.xxhash64("fp")), "wide-fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r1", "r2")).alias("first")
    nodes = written(fps.groupBy("node").agg(first, F.first("fp").alias("fp")), "wide-nodes")
    bits, differs = 64 * CHECK_WORDS, bit_differs(similarity)
    most = round(bits * differs + CHECK_SIGMAS * (bits * differs * (1 - differs)) ** 0.5)
    fields = ", ".join(f"w{i} long" for i in range(CHECK_WORDS))
    filed = spread(nodes.select("node", "fp"), 2 * (64 * words // segment)).mapInArrow(_filed(segment), f"key long, node long, {fields}")
    likely = components(_near(filed, most, CHECK_WORDS, block), contracted=True)
    asked = nodes.select("node", F.col("first.r1").alias("r1"), F.col("first.r2").alias("r2")).join(likely, "node")
    texts = plain.join(asked.select("r1", "r2"), ["r1", "r2"], "left_semi").select("r1", "r2", "text")
    sets = map_slices(texts, cut, "r1 long, r2 long, n_shingles long, shingles binary").dropDuplicates(["r1", "r2"])
    sets = written(sets.join(asked, ["r1", "r2"]).select("node", F.col("root").alias("key"), "n_shingles", "shingles").where("n_shingles > 0"), "wide-sets")
    roots = components(alike_links(sets, similarity, shingles), contracted=True)
    grouped = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    stay = grouped.select(F.col("first.r1").alias(one), F.col("first.r2").alias(two))
    return base.join(stay, [one, two], "left_semi").dropDuplicates([one, two]).select(*every)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
