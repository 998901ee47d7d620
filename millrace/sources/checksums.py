"""SHA-256 of files in byte ranges: Spark's reader splits a file, tasks hand on the state of its hash."""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import drop_folder, durable_checkpoint, shared_folder

#: Files up to this size are hashed whole; larger ones in ranges of about this size, one a round.
RANGE_BYTES = 256 << 20
PIECE_BYTES = 16 << 10
#: Names that Hadoop's line reader would decompress.
CODEC_NAMES = r"\.(gz|bz2|deflate|snappy|lz4|zst|lzo_deflate|passthrough)$"
STATE, MARK, TAIL = -2, -1, 2**63 - 1
MARK_BYTES = b"\xef\xbb\xbf"  # the line reader drops a byte order mark at the start of a file
#: SHA256_CTX of openssl/sha.h: h[8], Nl, Nh, data[16], num, md_len.
CONTEXT_BYTES = 28 * 4

ROWS = "number int, start bigint, seq bigint, content binary"


def is_large() -> Column:
    """Of files to be read in ranges; on metadata alone, so that Spark opens no other file."""
    return (F.col("_metadata.file_size") > RANGE_BYTES) & ~F.col("_metadata.file_name").rlike(CODEC_NAMES)


def crypto() -> ctypes.CDLL | None:
    """The libcrypto that hashlib itself is linked with, if it exports the resumable form."""
    for name in (_hashlib.__file__, ctypes.util.find_library("crypto")):
        try:
            lib = ctypes.CDLL(name) if name else None
            if lib is not None and lib.SHA256_Init and lib.SHA256_Update and lib.SHA256_Final:
                lib.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)
                return lib
        except (AttributeError, OSError):
            continue
    return None


def first_state() -> bytes:
    context = ctypes.create_string_buffer(CONTEXT_BYTES)
    crypto().SHA256_Init(context)
    return context.raw


def cut(batches):
    """Lines of splits, in order, as pieces of the file: every line but the first of a file follows a newline."""
    split, seq, held, size = None, 0, [], 0

    def piece():
        content = b"".join(held)
        return pa.RecordBatch.from_pydict({
            "key": [split[0]], "start": pa.array([split[1]], pa.int64()), "seq": pa.array([seq], pa.int64()),
            "size": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary()),
        })

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, starts = batch.column("key"), batch.column("start").to_numpy()
        codes = keys.dictionary_encode().indices.to_numpy()
        border = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        for low, high in zip([0, *border.tolist()], [*border.tolist(), len(starts)]):
            now, lines = (keys[low].as_py(), int(starts[low])), batch.column("line").slice(low, high - low).to_pylist()
            if now != split:
                if held:
                    yield piece()
                split, seq, held, size = now, 0, [], 0
                if now[1] == 0:
                    held.append(lines.pop(0))
                    size = len(held[0])
            for line in lines:
                held += (b"\n", line)
                size += 1 + len(line)
                if size >= PIECE_BYTES:
                    yield piece()
                    seq, held, size = seq + 1, [], 0
    if held:
        yield piece()


def fold(finish: bool):
    """Carries the state of each file over its sorted pieces of a round; the last round gives the digests."""

    def run(batches):
        lib, number, context = crypto(), None, None

        def row():
            content = context.raw
            if finish:
                digest = ctypes.create_string_buffer(32)
                lib.SHA256_Final(digest, context)
                content = digest.raw
            return pa.RecordBatch.from_pydict({
                "number": pa.array([number], pa.int32()), "start": pa.array([STATE], pa.int64()),
                "seq": pa.array([0], pa.int64()), "content": pa.array([content], pa.binary()),
            })

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("number", "start", "content"))
            for now, start, content in zip(*columns):
                if start == STATE:  # sorts first of its file
                    if context is not None:
                        yield row()
                    number, context = now, ctypes.create_string_buffer(content, CONTEXT_BYTES)
                else:
                    lib.SHA256_Update(context, content, len(content))
        if context is not None:
            yield row()

    return run


def in_ranges(spark: SparkSession, path: str, pattern: str, large: DataFrame) -> DataFrame:
    """(file, bytes, sha256) of large files: (key, file, bytes) rows, key as in ``_metadata.file_path``."""
    numbered = durable_checkpoint(
        large.withColumn("number", F.row_number().over(Window.orderBy("key")) - F.lit(1))  # one row per large file
    )
    files, longest = numbered.agg(F.count(F.lit(1)), F.max("bytes")).first()
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    )
    pieces = (
        lines.where(is_large())
        .select(
            F.col("_metadata.file_path").alias("key"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("value").cast("binary").alias("line"),
        )
        .mapInArrow(cut, "key string, start bigint, seq bigint, size bigint, content binary")
        .join(F.broadcast(numbered.select("key", "number")), "key")
        .select("number", "start", "seq", "size", "content", F.floor(F.col("start") / RANGE_BYTES).alias("round"))
    )
    folder = shared_folder(spark, "checksums")
    try:
        pieces.write.partitionBy("round").parquet(folder)
        stored = spark.read.schema(pieces.schema).parquet(folder)

        # What the line reader left out: a byte order mark (3 bytes), a newline at the end (1), or both.
        missing = durable_checkpoint(
            numbered.join(stored.groupBy("number").agg(F.sum("size").alias("read")), "number", "left").select(
                "number", (F.col("bytes") - F.col("read")).alias("missing")
            )
        )
        if missing.where("missing IS NULL OR missing NOT IN (0, 1, 3, 4)").count():
            raise RuntimeError(f"a file under {path} changed while it was read")
        marks = missing.where("missing >= 3").select("number", F.lit(MARK).alias("start"), F.lit(MARK_BYTES).alias("content"))
        tails = missing.where("missing IN (1, 4)").select("number", F.lit(TAIL).alias("start"), F.lit(b"\n").alias("content"))
        state = numbered.select("number", F.lit(STATE).alias("start"), F.lit(first_state()).alias("content"))

        def rows(df: DataFrame) -> DataFrame:
            seq = F.col("seq") if "seq" in df.columns else F.lit(0)
            return df.select(
                F.col("number").cast("int"), F.col("start").cast("bigint"), seq.cast("bigint").alias("seq"), "content"
            )

        last = (longest - 1) // RANGE_BYTES
        for at in range(last + 1):
            parts = rows(state).union(rows(stored.where(F.col("round") == at)))
            parts = parts.union(rows(marks)) if at == 0 else parts
            parts = parts.union(rows(tails)) if at == last else parts
            dealt = parts.repartitionById(files, F.col("number")).sortWithinPartitions("number", "start", "seq")
            state = durable_checkpoint(dealt.mapInArrow(fold(at == last), ROWS))
    finally:
        drop_folder(spark, folder)
    return numbered.join(F.broadcast(state), "number").select(
        "file", "bytes", F.lower(F.hex("content")).alias("sha256")
    )


def file_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) per file.

    Files over ``RANGE_BYTES`` are hashed in ranges, at once. Those with the name of
    a codec, which Spark reads in ranges only after decompression, are read whole, as
    is every file where Python's hashlib comes without an open libcrypto.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    name = F.substring_index("path", "/", -1)
    facts = (name.alias("file"), F.col("length").alias("bytes"))
    large = files.where(is_large()).select(F.col("_metadata.file_path").alias("key"), *facts)
    ranged = crypto() is not None and not large.isEmpty()
    whole = (files.where(~is_large()) if ranged else files).select(*facts, F.sha2("content", 256).alias("sha256"))
    return whole.union(in_ranges(spark, path, pattern, large)) if ranged else whole
