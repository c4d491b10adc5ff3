"""How many tasks share a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task sorts or counts at once, and rows that are worth a task of their own.
MOST, LEAST = 250_000, 10_000


def tasks(df: DataFrame, most: int = MOST) -> int:
    """Tasks for an exchange of ``df``, so that one has about ``most`` rows however large the table is.

    It is counted, so ``df`` has to be a table or something stored: of those only the footers are read.
    """
    n = df.count()
    return max(1, -(-n // most), min(df.sparkSession.sparkContext.defaultParallelism, n // LEAST))
