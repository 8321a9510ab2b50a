"""Continuous ingest: annotated files that arrive in a folder become event rows in a Parquet table.

Structured Streaming reads each new file whole, the same parsers run in ``mapInPandas``, and the sink is
append-only with a checkpoint, so a restarted query goes on where it was. ``open_events`` makes a corpus of what has arrived.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import readers
from ..sources.corpus import Corpus


def start(spark: SparkSession, source: str, target: str, checkpoint: str, form: str, split_feats: bool = False, **trigger):
    """Starts the query; trigger as for DataStreamWriter.trigger (availableNow=True reads what is there and ends)."""
    parse = readers.PARSERS[form]
    files = spark.readStream.format("text").option("wholetext", True).load(source)
    files = files.select(F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(1 << 30)).alias("file"), F.col("value"), F.col("_metadata.file_path").alias("path"))

    def run(frames):
        for f in frames:
            for number, value, path in zip(f.file, f.value, f.path):
                one = type(f)({"file": [number], "value": [value]})
                for out in readers.events_of([one], parse, split_feats):
                    yield out.assign(path=path)

    events = files.mapInPandas(run, f"file long, {readers.EVENTS}, path string")
    return events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def open_events(spark: SparkSession, target: str) -> Corpus:
    """The corpus of all events that have arrived; files are numbered by path, so that a late one takes its place."""
    events = spark.read.parquet(target)
    order = events.select("path").distinct().withColumn("nr", F.row_number().over(W.orderBy("path")).cast("long") - 1)
    events = events.join(order, "path").drop("file", "path").withColumnRenamed("nr", "file")
    return readers.assemble(events.persist())
