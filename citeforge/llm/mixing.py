"""Mixing sources to target weights by systematic sampling.

Targets: sources by code point, null last, weigh 3, 1, 2 and again; together they are to take
150 % of all words, none more than twice its own size; what a capped source leaves is shared
among the others by weight (water filling, solved in one pass over the sources).

Sampling: each document of a source expects target / source size copies. Documents stand in
order of size, so that neighbours are alike; the prefix sum of expected copies plus one offset
of the source crosses an integer as often as the document is emitted. Because the expectation is
the same for all documents of a source, the prefix sum is the rate times the rank, and the rank
comes from counts of (source, size) and (source, size, id bucket) cells: no task ever sorts a
source, and a source that holds a third of all rows is spread over all tasks.

Null text has size 0; null source is a source of its own; documents of size 0 take nothing.
Repeated rows are separate documents. Ties in size go by id modulo BUCKETS, then id, then a hash of the text and carried columns,
so reruns repeat the same rows. Only doc_id, text, source and carried columns are read; a carried one keeps its values as
carry_<name>. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, word_count, written

WEIGHTS, SHARE, CAP, BUCKETS, SEED = (3, 1, 2), 1.5, 2.0, 1024, "mix"


def _key(source: Column) -> Column:
    """Null as a key of its own, so that plain equality joins do."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def source_targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """src, total -> src, source_size, target, rate, shift. One row a source, so windows over all of them are small."""
    by_name, by_fill = W.orderBy("src_order"), W.orderBy("fill", "src_order").rowsBetween(W.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    everything = W.partitionBy()
    lined = totals.withColumn("src_order", F.struct(F.col("src") == "-", F.col("src"))).withColumn("w", weight)
    lined = lined.withColumn("most", F.lit(cap) * F.col("total")).withColumn("fill", F.col("most") / F.col("w"))
    before = F.coalesce(F.sum("most").over(by_fill), F.lit(0.0))
    w_before = F.coalesce(F.sum("w").over(by_fill), F.lit(0.0))
    level = (F.lit(share) * F.sum("total").over(everything) - before) / (F.sum("w").over(everything) - w_before)
    filled = lined.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("most"), F.col("level") * F.col("w"))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.col("src"))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    rate = F.when(F.col("total") > 0, target / F.col("total")).otherwise(F.lit(0.0))
    return filled.select("src", F.col("total").alias("source_size"), target.alias("target"), rate.alias("rate"), shift.alias("shift"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, carry: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, and the columns of `carry` as carry_<name>, one row a document."""
    cell = ["src", "size", "bucket"]
    key = [_key(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"), F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(BUCKETS)), F.lit(-1)).alias("bucket")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, F.xxhash64("text", *[F.col(f"`{c}`") for c in carry]).alias("tie"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    cells = written(rows.groupBy(*cell).agg(F.count("*").alias("n")), "mix-cells")
    by_size = cells.groupBy("src", "size").agg(F.sum("n").alias("m"))
    first = by_size.select("src", "size", F.coalesce(F.sum("m").over(W.partitionBy("src").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inner = cells.select(*cell, F.coalesce(F.sum("n").over(W.partitionBy("src", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("beside"))
    targets = source_targets(by_size.groupBy("src").agg(F.sum(F.col("m") * F.col("size")).alias("total")), weights, share, cap)
    places = inner.join(first, ["src", "size"]).join(targets, "src")
    rank = F.col("below") + F.col("beside") + F.row_number().over(W.partitionBy(*cell).orderBy("doc_id", "tie"))
    lined = rows.join(places, cell).withColumn("rank", rank)
    edge = lambda n: F.floor(F.col("rate") * n + F.col("shift"))
    copies = edge(F.col("rank")) - edge(F.col("rank") - 1)
    return lined.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), *[f"carry_{c}" for c in carry])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    many = mix(docs, carry=tuple(docs.columns), **options).where("copies > 0")
    again = many.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"carry_{n}").alias(n) for n in docs.columns])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
t AS (SELECT src, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY src),
w AS (SELECT src, total, CASE (row_number() OVER (ORDER BY src = '-', src) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM t),
l AS (SELECT src, total, w, 2.0::DOUBLE * total AS most,
        (1.5::DOUBLE * sum(total) OVER () - coalesce(sum(2.0::DOUBLE * total) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS lev
      FROM w WINDOW f AS (ORDER BY (2.0::DOUBLE * total) / w, src = '-', src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT src, total, least(most, max(lev) OVER () * w) AS target,
        CAST(CAST('0x' || substr(md5('mix' || src), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS shift FROM l),
r AS (SELECT doc_id, src, size, row_number() OVER (PARTITION BY src ORDER BY size, CASE WHEN doc_id IS NULL THEN -1 ELSE doc_id % 1024 END, doc_id NULLS FIRST) AS n FROM d)
SELECT doc_id, size, total AS source_size, target,
  CASE WHEN total > 0 THEN CAST(floor(target / total * n + shift) - floor(target / total * (n - 1) + shift) AS BIGINT) * size ELSE 0 END AS taken
FROM r JOIN m USING (src)
"""
