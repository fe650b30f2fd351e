"""Structured Streaming: windows over events, and incremental ingest of documents.

Offsets and state live in a checkpoint folder on storage that all executors
share; a batch that is run again after a failure writes the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphweir.functions.identity import chunk_id, doc_id
from graphweir.functions.text import strip
from graphweir.operators.text import word_chunks
from graphweir.session import checkpoint_dir


def table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the data directory as a stream; its schema is that of the stored files."""
    path = f"{directory.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a glob, since a streamed path may be one file or a folder of files
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{directory.rstrip('/')}/{name}.parque[t]")
    # watermarks need timestamps of an instant
    return stream.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields])


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling or sliding window and type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there, and reads its result table.

    In complete mode each batch replaces the table, in append mode it adds a
    part of its own, named by the batch, so that a repeated batch repeats no row.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table" if mode == "complete" else f"{root}/table/batch={number}")

    query: StreamingQuery = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/table").select(*stream.columns)


def ingest_batch(batch: DataFrame, documents: DataFrame | None, chunks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """New documents and chunks of a batch of (text): strip, hash, drop known documents, chunk, drop known chunks."""
    docs = batch.select(strip(F.col("text")).alias("content")).where("content != ''").select(doc_id(F.col("content")).alias("doc_id"), "content").dropDuplicates(["doc_id"])
    if documents is not None:
        docs = docs.join(documents.select("doc_id"), "doc_id", "left_anti")
    new = word_chunks(docs, "doc_id", "content").select("chunk_id", "content", F.col("doc_id").alias("full_doc_id"), "chunk_order_index").dropDuplicates(["chunk_id"])
    if chunks is not None:
        new = new.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return docs, new


def ingest_stream(stream: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Ingests a stream of texts into ``folder``/documents and ``folder``/chunks.

    Each batch writes parts named by its number; what it compares with are the
    parts of earlier batches, so that running a batch again changes nothing.
    """
    spark = stream.sparkSession

    def earlier(name: str, number: int) -> DataFrame | None:
        paths = [f"{folder}/{name}/batch={k}" for k in range(number)]
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
        return spark.read.parquet(*there) if there else None

    def write(batch: DataFrame, number: int) -> None:
        docs, chunks = ingest_batch(batch, earlier("documents", number), earlier("chunks", number))
        docs.write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["chunk_id", "ingest_batch", "ingest_stream", "run_to_table", "sessions", "table_stream", "windowed"]
