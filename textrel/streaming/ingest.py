"""Documents as a stream: each micro-batch is chunked, sieved and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textrel.operators.chunks import chunk_id, recursive_chunks, sieve


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string", files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, chunks_folder: str, checkpoint: str, keywords: list[str] | None = None) -> StreamingQuery:
    """Chunks of a document stream as Parquet, a folder ``batch=<n>`` per micro-batch.

    Documents that came before are known from the stream's own state, which is keyed by doc_id (the first text of an id
    counts), so no batch reads what is stored. A batch that is run again writes its folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        pieces = recursive_chunks(batch, "doc_id", "text").withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index")))
        kept = sieve(pieces, "content", keywords) if keywords else pieces
        kept.select("doc_id", "chunk_index", "content", "chunk_id").write.mode("overwrite").parquet(f"{chunks_folder}/batch={number}")

    once = stream.dropDuplicates(["doc_id"])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_chunks(spark: SparkSession, chunks_folder: str) -> DataFrame:
    """What ingest has written so far."""
    return spark.read.parquet(chunks_folder).drop("batch")


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per type and window of a stream or table, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
