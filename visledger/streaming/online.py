"""Extensions for streams: windowed counts, and detection scores kept up to date as results arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", keys: tuple = ("event_type",)) -> DataFrame:
    """``window_start, <keys>, n, total`` by event time; works on a stream or a table alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    g = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def running_curve(binary: DataFrame, bins: int = 1000) -> DataFrame:
    """``bin, t, f``: weights of true and false rows by score bin, of a stream or a table.

    Bins are fixed, so counts of any two runs add up; a curve follows from the
    table by a running sum (:func:`visledger.operators.curves.curve`).
    """
    b = F.least(F.greatest(F.floor(F.col("pred_score") * bins), F.lit(-1)), F.lit(bins)).cast("long")
    w = F.col("weight") * F.col("is_true")
    return binary.groupBy(b.alias("bin")).agg(F.sum(w).alias("t"), F.sum(F.col("weight") - w).alias("f"))


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain a stream that has an end into a table in memory (for trials)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)
