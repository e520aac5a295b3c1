"""Flush intervals as micro-batches: each trigger aggregates what arrived, without state between batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterloom.config import EngineConfig
from meterloom.functions.protocol import parse_lines
from meterloom.operators import emit
from meterloom.sources import binary

Sink = Callable[[DataFrame, int], object]


def flush_batch(samples: DataFrame, cfg: EngineConfig, at: int | None = None) -> DataFrame:
    """The flushed rows of one interval, stamped with the second of the flush."""
    return emit.flush(samples, cfg, F.lit(int(time.time()) if at is None else at), binary=cfg.binary_stream)


def start(samples: DataFrame, cfg: EngineConfig, sink: Sink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Flush a stream of samples every flush_interval seconds; once: flush what is there and stop.

    Triggers fall on multiples of the interval, as an aligned flush does. Stop the query to end; call start(once=True)
    with the same checkpoint for the final flush. A batch that was interrupted is delivered again under its batch id,
    so sinks that must not repeat keep the last id.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())
        rows = rows.persist()
        try:
            sink(flush_batch(rows, cfg), batch_id)
        finally:
            rows.unpersist()

    writer = samples.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{cfg.flush_interval} seconds")
    return writer.start()


def start_raw(chunks: DataFrame, cfg: EngineConfig, sink: Sink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """The same for a stream of received chunks (seq, data) of either protocol, as a listener gives them."""

    def each(batch: DataFrame, batch_id: int) -> None:
        chunks = batch.select(F.col("seq").alias("chunk_no"), "data").persist()
        try:
            sink(flush_batch(binary.parse_mixed(chunks, counted=bool(cfg.input_counter)), cfg), batch_id)
        finally:
            chunks.unpersist()

    writer = chunks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{cfg.flush_interval} seconds")
    return writer.start()


def start_lines(lines: DataFrame, cfg: EngineConfig, sink: Sink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """The same for a stream of protocol lines."""
    return start(parse_lines(lines, counted=bool(cfg.input_counter)), cfg, sink, checkpoint, once)


def replay(samples: DataFrame, cfg: EngineConfig, ts: str = "ts") -> DataFrame:
    """Batch form for recorded samples: one flush per aligned interval of `ts`, all at once.

    Adds the window's start; the stamp is its end. Every aggregate is grouped by the window, so intervals run in parallel.
    """
    w = samples.withColumn("window_start", F.window(F.col(ts).cast("timestamp"), f"{cfg.flush_interval} seconds")["start"])
    stamp = F.unix_timestamp("window_start") + F.lit(cfg.flush_interval)
    return emit.flush(w, cfg, stamp, by=("window_start",), binary=cfg.binary_stream)


def windowed_counts(samples: DataFrame, seconds: int, late: str, ts: str = "ts") -> DataFrame:
    """Event-time form for streams with a watermark: counters and timers per window, late samples up to `late` included."""
    x = samples.withWatermark(ts, late).where(F.col("type").isin("c", "ms"))
    return x.groupBy(F.window(ts, f"{seconds} seconds").alias("window"), "type", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.when(F.col("type") == "c", 1.0 / F.col("sample_rate")).otherwise(1.0)).alias("sum")
    )
