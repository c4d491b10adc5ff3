"""What the operators share: the shared folder, saved tables, Arrow plumbing and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: For words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after LOWER: all ASCII but 0-9 and a-z splits. UTF-8 has no ASCII byte inside a longer character.
PLAIN_WORDS = bytes(
    (c := b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256)
)


#: Tasks that one key's rows are dealt to in ``spread_join``.
SALTS = 8
#: Where ``saved`` wrote a table.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine in local mode (tests); a cluster has to set it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote for these tables, of which nothing is read any more."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            drop_path(table.sparkSession, path)


def spread_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``many.join(few, on, how)`` where ``few`` has a key once and ``many`` may have one in any share of its rows: those meet SALTS copies of the key."""
    salt = F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through Hadoop's own file system, whatever its scheme."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """``make()`` runs once a task and returns a function from one Arrow batch to dicts of columns of ``schema``.

    Columns may be lists, numpy or Arrow arrays; each dict becomes one output batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spec = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(spec)
        give_back()
        step = make()
        for batch in batches:
            for out in step(batch):
                yield pa.RecordBatch.from_arrays([_as_array(out[f.name], f.type) for f in arrow], schema=arrow)
        step = batch = out = None
        give_back()

    return df.mapInArrow(run, spec)


def give_back() -> None:
    """Returns memory that was freed to the system. Workers serve many tasks and would keep the most that any of them took."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column without decoding it; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(column: pa.Array, missing: int = -1) -> np.ndarray:
    """Longs of a column as numpy; null becomes ``missing``."""
    return column.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    return text.translate(PLAIN_WORDS).split()


def columns_as(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns, clashing ones too, stay outside."""
    return df.select(*(F.col(f"`{theirs}`").alias(ours) for ours, theirs in names.items()))
