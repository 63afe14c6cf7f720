"""Streams: windowed counts with late data, and an idempotent record store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators import ingest, merge


def window_counts(stream: DataFrame, time: str, keys: list[str], length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by window and key; rows later than ``late`` are dropped. The state
    holds the open windows only."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, length, slide or length).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def session_counts(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Counts by sessions, which a pause of ``gap`` ends."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def distinct_records(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Records once each among those that arrive within ``late``; keeps the
    state small in front of the store, which is exact."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["entity_id", "checksum"])


def store_stream(spark: SparkSession, records: DataFrame, store: str, dead: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Inserts valid records that the Parquet store lacks; the others go to
    ``dead`` as JSON lines.

    A batch is written to a folder named by its number, overwriting what an
    attempt before left there, and is compared with all other batches only: a
    batch that is run again after a failure gives the same store.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.persist()
        valid, bad = ingest.split_valid(batch)
        try:
            stored = session.read.parquet(store).where(F.col("batch") != number).select("entity_id", "checksum")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = valid.select("entity_id", "checksum").limit(0)
        merge.insert_or_ignore(valid, stored, ["entity_id", "checksum"], "record_id").write.mode("overwrite").parquet(f"{store}/batch={number}")
        bad.write.mode("overwrite").json(f"{dead}/batch={number}")
        batch.unpersist()

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
