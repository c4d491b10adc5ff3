"""Tables kept between the rounds of an iterative plan."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame

#: Where ``stored`` wrote a table.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of spark.checkpoint.dir and read back, so later rounds do not repeat earlier ones.

    Where that is unset, a folder of this machine in local mode (tests); a cluster has to set it.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/helixframe/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these tables, of which nothing is read any more."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
