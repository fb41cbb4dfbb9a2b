"""Detection and redaction of streams, and counts of findings by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudspark.config import Settings
from shroudspark.operators.detect import explode_spans, with_spans
from shroudspark.operators.redact import redact

__all__ = ["counts_by_window", "findings", "redact"]


def findings(stream: DataFrame, keys: list[str], text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(keys, type) for each span; stateless, so every output mode will do."""
    found = with_spans(stream.select(*keys, F.col(text_col).alias("__text")), "__text", settings)
    return explode_spans(found, "spans", keys).select(*keys, F.col("s.type").alias("type"))


def counts_by_window(
    stream: DataFrame, time_col: str, text_col: str = "text", window: str = "5 minutes", late: str = "10 minutes", settings: Settings = Settings()
) -> DataFrame:
    """(start, end, type, n) of event-time windows; rows later than ``late`` are left out, and state goes with them."""
    found = findings(stream.withWatermark(time_col, late), [time_col], text_col, settings)
    grouped = found.groupBy(F.window(time_col, window), "type").agg(F.count("*").alias("n"))
    return grouped.select("window.start", "window.end", "type", "n")
