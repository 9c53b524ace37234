"""An extension for streams: exact duplicates within a watermark, and runs of events by session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def exact_within(stream: DataFrame, time_col: str, delay: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the delay; state is kept for that long only."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def gap_runs(df: DataFrame, time_col: str, gap: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """(keys, start, end, n) of runs of rows less than a gap apart; for streams with a watermark of `delay`."""
    at = df.withWatermark(time_col, delay) if delay else df
    # a session takes in what begins right at its end, so it ends a microsecond, the least step of a timestamp, before the gap does
    got = at.groupBy(*keys, F.session_window(time_col, f"{gap} -1 microseconds").alias("w")).agg(F.count("*").alias("n"))
    return got.select(*keys, F.col("w.start").alias("start"), (F.col("w.end") + F.expr("interval 1 microsecond")).alias("end"), "n")
