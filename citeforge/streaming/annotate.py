"""Structured Streaming around the batch matcher.

The matcher's first-match choice is an aggregation, which an append stream would need a watermark
for; each micro-batch is therefore matched by the batch code in foreachBatch. A node is handled
once: dropDuplicatesWithinWatermark keeps the keys of the last while, or, without event time,
dropDuplicates keeps all. A failing batch is reported and does not end the stream if on_error is given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as T
from ..operators.labels import labels
from ..operators.match import Catalogs, lookup
from ..sources.tables import dropped_at_end, shared_dir


def once(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first event of each key; with event_time the state is bounded by the lateness."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    timed = stream.withColumn(event_time, stream[event_time].cast("timestamp"))
    return timed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def annotate(stream: DataFrame, catalogs: Catalogs, out: str, checkpoint: str, settings: dict | None = None, on_error: Callable[[int, Exception], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """stream: page_id, node_id, raw. Writes page_id, node_id, raw, labels to out, a folder a batch, so a replayed batch overwrites itself."""

    def batch(df: DataFrame, batch_id: int) -> None:
        try:
            rows = df.persist()
            found = lookup(rows.select("raw"), catalogs).select(F.col("raw").alias("key"), labels(settings).alias("labels"))
            keyed = rows.withColumn("key", F.expr(T.trim(T.text("raw"))))
            keyed.join(found, "key", "left").select("page_id", "node_id", "raw", "labels").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            rows.unpersist()
        except Exception as e:
            if on_error is None:
                raise
            on_error(batch_id, e)

    query = once(stream, ["page_id", "node_id"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"processingTime": "1 second"})).start()


def drain(spark: SparkSession, path: str, schema: str, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Reads a folder of Parquet files as a stream to its end and returns each key's first row (a batch DataFrame).

    With event_time the state forgets keys older than the lateness; without, it keeps them all, which suits a bounded folder.
    """
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(file).isFile():  # a file source reads folders
        reader, path = reader.option("pathGlobFilter", file.getName()), file.getParent().toString()
    stream = reader.parquet(path)

    def batch(df: DataFrame, batch_id: int) -> None:
        df.select(*stream.columns).write.mode("overwrite").parquet(f"{place}/rows/batch={batch_id}")

    first = once(stream, keys) if event_time is None else once(stream.withColumn("__time", stream[event_time]), keys, "__time", late)
    first.writeStream.foreachBatch(batch).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    dropped_at_end(spark, place)
    return spark.read.schema(schema).parquet(f"{place}/rows/batch=*")
