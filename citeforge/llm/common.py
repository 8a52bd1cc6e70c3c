"""What the operators of this subpackage share: tables, words, shared folders, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word; everything else is part of one.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Documents are handed to numpy in slices of about this many bytes.
SLICE_BYTES = 1 << 20

#: Rows that a task makes of its own where each becomes many.
TASK_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table does not have, whatever its case rules."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_array(text: Column) -> Column:
    """Array of words; empty for null and for text without a word."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")
    # a single-character split takes Java's fast path
    return F.filter(F.split(clean, " "), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words (long), without building the words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Unset, only a local master has one of its own: there all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def dropped_at_end(spark: SparkSession, path: str) -> None:
    """Removes the folder when the JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet into the shared folder and reads them again.

    Survives lost executors (the files are in the shared store) and goes away when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    dropped_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, fan: int) -> DataFrame:
    """Rows that each are about to become `fan`, dealt over as many tasks as TASK_ROWS needs."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * fan // TASK_ROWS)))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice has at most about `most` bytes of text, or one row."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, '' for null."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column, most):
                yield fn(part)

    return df.mapInArrow(run, schema)


def crc_rest(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(n), F.lit(-1))
