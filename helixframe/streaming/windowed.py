"""Streams of leads: the batch grid kept up to date, with late leads left out past the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import bin_of


def windowed_leads(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, contig, bin, n, value) of ``events`` (ts, contig, ref_start, value): a stream or a table."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", window), "contig", bin_of("ref_start").alias("bin"))
    return x.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "contig", "bin", "n", "value")
