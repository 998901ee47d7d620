"""Helpers shared by the corpus operators: stored tables, text columns as bytes, word hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = 2**63 - 1
PARTITION_BYTES = 64 << 20
#: What separates words: space and the control characters tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the one that ``spark.checkpoint.dir`` names.

    Executors do not share local disks, so a temporary folder is used only
    when the session runs in local mode and names none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        set_dir = spark.sparkContext.getCheckpointDir()
        if set_dir is not None:
            root = set_dir
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            import tempfile

            root = tempfile.mkdtemp(prefix="millrace-llm-")
            spark.conf.set("spark.checkpoint.dir", root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files behind a table made by ``stored`` once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` such that a join with it shuffles both sides.

    Spark takes an exploded array for one element a row, and a stored table for as large as its compressed files; by such
    a size it would collect on the driver what is a hundred times as large in memory.
    """
    return df.hint("merge")


def parallelism(df: DataFrame) -> int:
    """Shuffle partitions for a table: those of the session, or one for each ``PARTITION_BYTES`` of input if that is more.

    The size is the one the optimizer knows of the input files. Sources of
    unknown size, which it takes for endless, use the session's setting.
    """
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(session, -(-known // PARTITION_BYTES)) if known < 1 << 50 else session


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def order_id(name: str = "doc_id") -> Column:
    """The id as a long, with null after all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), pa.int64())


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
