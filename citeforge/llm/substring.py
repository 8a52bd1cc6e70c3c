"""Substring dedup: winnowed anchors as seeds, extended to maximal repeats.

A window is WINDOW consecutive words of one document. Each window elects as its anchor the least
hash among its SEED-word grams (the rightmost of equal ones), so two equal windows elect the same
gram at the same place, and a run of neighbouring windows shares an anchor: about one row in
fourteen words is shuffled instead of one a window.

Seeds: anchors whose gram occurs once in the corpus are dropped; none of their windows repeats.
Extension: from the gram to the left and right, over all of its occurrences at once: the words under all windows of
an anchor are digested as one span. If all occurrences of a gram have the same span, all these windows repeat
at once. Otherwise the match of some ends somewhere within, and the windows are digested one by one and counted (key: gram digest and
window digest, 128 bits). Repeated windows that overlap or touch are the maximal repeats; every
occurrence is removed, the first included.

Null text has no words. Documents are told apart by 128 bits of id and text, and each row counts as a
document, so the windows of a repeated row repeat; empty and short texts keep all words. An empty table gives
no row. Other columns are not read, whatever their names. A text of any length is read whole; a worker holds some
50 bytes a byte of the longest one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, texts_of, written

WINDOW, SEED = 35, 9
#: A row is known by 128 bits of its id and text.
RID = ["rid", "rid2"]
#: A key with more than one in so many rows is hot.
HOT_SHARE = 1000
#: Bytes of text, and of compressed text, that a worker holds as arrays at a time.
TEXT_BYTES, PACKED_BYTES = 1 << 20, 1 << 18
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they have inverses modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        _powers[base] = np.multiply.accumulate(full)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts as arrays: document, and prefix sums from which any run is digested."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends_of_text = np.cumsum([len(t) + 1 for t in texts])
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, len(data)), out=total[1:])
        inverse = pow(_P, -1, 1 << 64)
        word = (total[ends] - total[starts]) * _power(inverse, len(data))[starts]
        word = _mix(word + (ends - starts).astype(np.uint64) * np.uint64(_Q))
        self.n = len(word)
        self.doc = np.searchsorted(ends_of_text, starts, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(word * _power(_Q, self.n), out=self.sums[1:])
        self.back = _power(pow(_Q, -1, 1 << 64), self.n + 1)

    def runs(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Digest of the words at .. at + length."""
        return _mix((self.sums[at + length] - self.sums[at]) * self.back[at])

    def anchors(self, window: int, seed: int) -> tuple[np.ndarray, ...]:
        """First window (global word index), number of windows, gram digest, span digest, of each anchor."""
        none = np.zeros(0, np.int64)
        if self.n < window:
            return none, none, none.view(np.uint64), none.view(np.uint64)
        grams = self.runs(np.arange(self.n - seed + 1), seed)
        n = self.n - window + 1
        least, at = grams[:n].copy(), np.zeros(n, np.int64)
        for d in range(1, window - seed + 1):
            here = grams[d : d + n]
            at[here <= least] = d
            np.minimum(least, here, out=least)
        at += np.arange(n)
        valid = self.doc[:n] == self.doc[window - 1 :]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1] | (self.doc[1:n] != self.doc[: n - 1])
        first = np.flatnonzero(new & valid)
        # a group ends where the next one starts or the windows leave the document
        stop = np.append(np.flatnonzero(new | ~valid), n)
        many = stop[np.searchsorted(stop, first, side="right")] - first
        span = _mix(self.runs(first, many + (window - 1)) ^ (many.astype(np.uint64) << np.uint64(32)) ^ (at[first] - first).astype(np.uint64))
        return first, many, grams[at[first]], span


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def anchor_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """rid, rid2, text -> rid, rid2, start (word of the first window), many (windows), gram, span."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words([t.encode() for t in texts_of(batch)])
        first, many, gram, span = w.anchors(window, seed)
        doc = w.doc[first]
        own = [_long(np.asarray(batch.column(c))[doc]) for c in RID]
        return pa.record_batch([*own, pa.array((first - w.first[doc]).astype(np.int32)), pa.array(many.astype(np.int32)), _long(gram), _long(span)], names=[*RID, "start", "many", "gram", "span"])

    return map_slices(docs.select(*RID, "text"), run, "rid long, rid2 long, start int, many int, gram long, span long", most=TEXT_BYTES)


def packed_documents(docs: DataFrame) -> DataFrame:
    """rid, rid2, doc_id, packed: the text compressed, since it is about to be shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.record_batch([*[batch.column(c) for c in RID], batch.column("doc_id"), pa.array([pack(t.encode()) for t in texts_of(batch)], pa.binary())], names=[*RID, "doc_id", "packed"])

    return map_slices(docs.select(*RID, "doc_id", "text"), run, "rid long, rid2 long, doc_id long, packed binary")


def _unpack(col: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in col.to_pylist()]


def window_rows(listed: DataFrame, window: int) -> DataFrame:
    """rid, rid2, packed, spots (array of start, many, gram) -> rid, rid2, start, gram, word window digest: a row each window."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(_unpack(batch.column("packed")))
        spots = batch.column("spots")
        # flatten() follows the slice of the batch, values would not
        rows, doc = spots.flatten(), np.repeat(np.arange(len(batch)), np.diff(np.asarray(spots.offsets)))
        start, many, gram = (np.asarray(rows.field(i)) for i in range(3))
        rep = np.repeat(np.arange(len(start)), many)
        local = start[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
        digest = w.runs(local + w.first[doc[rep]], window)
        own = [_long(np.asarray(batch.column(c))[doc[rep]]) for c in RID]
        return pa.record_batch([*own, pa.array(local.astype(np.int32)), _long(gram[rep]), _long(digest)], names=[*RID, "start", "gram", "digest"])

    return map_slices(listed.select(*RID, "packed", "spots"), run, "rid long, rid2 long, start int, gram long, digest long", "packed", PACKED_BYTES)


def _cut(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    texts, n_words, n_removed, removed = [], [], [], []
    for text, spots in zip(_unpack(batch.column("packed")), batch.column("spots").to_pylist(), strict=True):
        words = text.split()
        spans: list[list[int]] = []
        for start, many in sorted((s["start"], s["many"]) for s in spots or ()):
            end = start + many + window - 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
        kept, at = [], 0
        for a, b in spans:
            kept += words[at:a]
            at = b
        kept += words[at:]
        texts.append(b" ".join(kept).decode())
        n_words.append(len(words))
        n_removed.append(len(words) - len(kept))
        removed.append([{"start": a, "stop": b} for a, b in spans])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    return pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kind)], names=["doc_id", "text", "n_words", "n_removed", "removed"])


def _with_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of rows with distinct keys (which have n, the number of rows of each key), whatever the skew.

    Keys of more than one row in HOT_SHARE are fewer than HOT_SHARE, so they are broadcast; their rows are dealt over as
    many parts as that share of rows needs, so no task gets more of a key.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1))).cast("int")
    hot = keys.withColumn("parts", parts).where("parts > 1").select(*on, "parts")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("salt", F.pmod(F.xxhash64(*RID, "start"), F.coalesce("parts", F.lit(1)))).drop("parts")
    again = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)).cast("long") - 1))).drop("n")
    return dealt.join(again, [*on, "salt"]).drop("salt")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, text (kept words), n_words, n_removed, removed (word spans): one row a document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("rid2", F.xxhash64(F.lit(1), "doc_id", "text"))
    found = anchor_rows(base, window, seed)
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("a"), F.max("span").alias("b")).where("n > 1")
    grams = written(grams.select("gram", "n", (F.col("a") != F.col("b")).alias("mixed")), "grams")
    seeds = written(_with_keys(found, grams, ["gram"]), "seeds")
    packed = packed_documents(base)
    listed = seeds.where("mixed").groupBy(*RID).agg(F.collect_set(F.struct("start", "many", "gram")).alias("spots"))
    # rows with one rid have one text: each takes the set of its anchors, so a window counts once a row
    windows = written(window_rows(packed.join(listed, RID), window), "windows")
    again = written(windows.groupBy("gram", "digest").agg(F.count("*").alias("n")).where("n > 1"), "again")
    hits = _with_keys(windows, again, ["gram", "digest"]).select(*RID, "start", F.lit(1).alias("many"))
    marks = seeds.where("not mixed").select(*RID, "start", "many").union(hits)
    # a set, made before the shuffle as well: equal rows mark the same words once
    spots = marks.groupBy(*RID).agg(F.collect_set(F.struct("start", "many")).alias("spots"))
    joined = packed.join(spots, RID, "left").select("doc_id", "packed", "spots")
    return map_slices(joined, lambda b: _cut(b, window), "doc_id long, text string, n_words long, n_removed long, removed array<struct<start:int,stop:int>>", "packed", PACKED_BYTES)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
g AS (SELECT r, p, n, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) AS k FROM x),
f AS (SELECT r, p, k FROM g WHERE p <= n - {WINDOW - 1}),
m AS (SELECT r, p AS s FROM f JOIN (SELECT k FROM f GROUP BY k HAVING count(*) > 1) USING (k)),
c AS (SELECT DISTINCT r, unnest(range(s, s + {WINDOW})) AS p FROM m),
t AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
