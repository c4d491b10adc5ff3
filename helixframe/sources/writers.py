"""Sinks: VCF and CSV text, block stores and population stores."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, STORE_VERSION, Params


def write_text(lines: DataFrame, path: str, header: list[str] | None = None, order: list[str] | None = None, gzip: bool = False) -> None:
    """Part files of ``line``, sorted by range over all parts; the header is a part of its own that sorts first."""
    spark = lines.sparkSession
    body = lines.orderBy(*order) if order else lines
    options = {"compression": "gzip"} if gzip else {}
    if header:
        spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.options(**options).text(f"{path}/header")
    body.select("line").write.options(**options).text(f"{path}/body")


def write_store(candidates: DataFrame, path: str, p: Params = DEFAULTS) -> None:
    """Candidates in folders by sample and contig, sorted by block, so that readers skip row groups."""
    x = candidates.withColumn("block", (F.floor(F.col("pos") / p.block_size) * p.block_size).cast("long"))
    x.repartition("sample_id", "contig", "block").sortWithinPartitions("sample_id", "contig", "block", "pos").write.partitionBy("sample_id", "contig").parquet(path)


def write_population(frequencies: DataFrame, path: str, p: Params = DEFAULTS) -> None:
    """Variants with their frequencies, in folders by contig, sorted by block."""
    x = frequencies.withColumn("block", (F.floor(F.col("pos") / p.block_size) * p.block_size).cast("long"))
    x.repartition("contig", "block").sortWithinPartitions("contig", "block", "pos").write.partitionBy("contig").parquet(path)


def write_sample(candidates: DataFrame, coverage: DataFrame, path: str, sample_id: str, version: str = STORE_VERSION, p: Params = DEFAULTS) -> None:
    """A sample's store: a header, its candidates without single breaks, and its binned depth (contig, cov_bin, depth). Rows are sorted by contig and block, so that readers of many stores skip row groups."""
    spark = candidates.sparkSession
    header = {"sample_id": sample_id, "version": version, "block_size": p.block_size, "coverage_bin": p.coverage_bin}
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.text(f"{path}/header")
    block = lambda c: (F.floor(F.col(c) / p.block_size) * p.block_size).cast("long")
    kept = candidates.where("svtype not like 'SINGLE%'").withColumn("block", block("pos"))
    kept.repartitionByRange("contig", "block").sortWithinPartitions("contig", "block", "pos").write.parquet(f"{path}/candidates")
    depth = coverage.select("contig", block("cov_bin").alias("block"), "cov_bin", "depth")
    depth.repartitionByRange("contig", "block").sortWithinPartitions("contig", "cov_bin").write.parquet(f"{path}/coverage")
