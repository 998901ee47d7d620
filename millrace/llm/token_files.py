"""Token ids in files, entropy-coded by a static range asymmetric numeral system.

All files share one frequency table of the whole corpus. Documents in id order
are cut into chunks of whole documents; a chunk's ids are coded in independent
blocks. Inside a block, ids are dealt in turn to lanes, each with a state of its
own, whose words lie interleaved in one stream.

A token store is a folder with two Parquet tables. ``frequencies`` has a row per
id: token, frequency (they add up to 2**SCALE). ``chunks`` has a row per chunk:
first_token, n_tokens, docs, sizes (tokens of each document), payload, crc32 of
the payload. A payload is, little-endian: magic, number of ids, lanes, block
length (32 bits each), the checksum of the ids as 32-bit integers, then for each
block its number of words and the state of every lane (64 bits), which are the
checkpoints where a decoder starts, then all words (32 bits).
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe_codec import byte_alphabet
from millrace.llm.common import LAST_ID, as_bytes, batch_of, drop_stored, order_id, parallelism, shared_folder, stored
from millrace.llm.token_counts import sql

SCALE = 20
LANES = 64
BLOCK = 1 << 15
#: Ids in a chunk, at least, unless its partition ends.
CHUNK = 1 << 20
#: Text that is encoded at once; longer texts are cut at gaps.
PART_BYTES = 1 << 21
#: What a worker remembers of words and pre-tokens, about.
MEMORY_BYTES = 96 << 20
#: Two small objects of the memory and their place in its table.
ENTRY_BYTES = 90
#: Below it, no letter composes with another and classes are the same in all Unicode releases.
PLAIN_END = "\u0250"
LOW = np.uint64(1 << 31)
MAGIC = b"rANS"
HEAD = struct.Struct("<4sIIII")

TOKENS = pa.schema(
    [
        ("part", pa.int64()),
        ("before", pa.int64()),
        ("docs", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("ids", pa.binary()),
    ]
)
COUNTS = pa.schema([("token", pa.int64()), ("n", pa.int64())])
CHUNKS = pa.schema(
    [
        ("first_token", pa.int64()),
        ("n_tokens", pa.int64()),
        ("docs", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("payload", pa.binary()),
        ("crc32", pa.int64()),
    ]
)
INDEX = pa.schema([("d", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts brought to a sum of ``2**scale``, with at least 1 for every id that occurs."""
    total, whole = int(counts.sum()), 1 << scale
    if total == 0:
        out = np.zeros(max(1, len(counts)), np.int64)
        out[0] = whole
        return out
    if int((counts > 0).sum()) > whole:
        raise ValueError("more ids than the scale has room for")
    out = np.where(counts > 0, np.maximum(1, np.floor(counts * (whole / total))), 0).astype(np.int64)
    over = int(out.sum()) - whole
    if over <= 0:
        out[int(counts.argmax())] -= over
    else:  # take from the largest, which stay above 1
        for i in np.argsort(-out, kind="stable").tolist():
            take = min(over, int(out[i]) - 1)
            out[i] -= take
            over -= take
            if not over:
                break
    return out


class Coder:
    """Encoder and decoder of blocks for one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE) -> None:
        self.scale = scale
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - scale)
        self.filler = int(freq.argmax())
        self._slots: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> bytes:
        blocks = max(1, -(-len(ids) // BLOCK))
        steps = -(-min(BLOCK, max(1, len(ids))) // LANES)
        padded = np.full(blocks * steps * LANES, self.filler, np.int64)
        padded[: len(ids)] = ids
        grid = padded.reshape(blocks, steps, LANES)
        state = np.full((blocks, LANES), LOW, np.uint64)
        words = np.zeros((blocks, steps, LANES), np.uint32)
        spilled = np.zeros((blocks, steps, LANES), bool)
        shift, low32 = np.uint64(self.scale), np.uint64(0xFFFFFFFF)
        for step in range(steps - 1, -1, -1):
            symbol = grid[:, step]
            f = self.freq[symbol]
            out = state >= self.limit[symbol]
            words[:, step] = state & low32
            spilled[:, step] = out
            state = np.where(out, state >> np.uint64(32), state)
            high = state // f
            state = (high << shift) + (state - high * f) + self.start[symbol]
        head = HEAD.pack(MAGIC, len(ids), LANES, BLOCK, zlib.crc32(ids.astype("<u4").tobytes()))
        points = np.concatenate((spilled.sum(axis=(1, 2)).astype("<u8")[:, None], state.astype("<u8")), axis=1)
        return head + points.tobytes() + words[spilled].astype("<u4").tobytes()

    def decode(self, payload: bytes) -> np.ndarray:
        magic, size, lanes, block, crc = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("no token payload")
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))
        blocks = max(1, -(-size // block))
        steps = -(-min(block, max(1, size)) // lanes)
        points = np.frombuffer(payload, "<u8", blocks * (lanes + 1), HEAD.size).reshape(blocks, lanes + 1)
        words = np.frombuffer(payload, "<u4", -1, HEAD.size + points.nbytes).astype(np.uint64)
        words = np.append(words, np.zeros(lanes, np.uint64))
        state = points[:, 1:].copy()
        ends = np.cumsum(points[:, 0].astype(np.int64))
        at = ends - points[:, 0].astype(np.int64)
        out = np.empty((blocks, steps, lanes), np.int64)
        mask, shift = np.uint64((1 << self.scale) - 1), np.uint64(self.scale)
        for step in range(steps):
            slot = state & mask
            symbol = self._slots[slot.astype(np.int64)]
            out[:, step] = symbol
            state = self.freq[symbol] * (state >> shift) + slot - self.start[symbol]
            need = state < LOW
            place = np.cumsum(need, axis=1)
            more = (state << np.uint64(32)) | words[np.minimum(at[:, None] + place - need, len(words) - 1)]
            state = np.where(need, more, state)
            at = at + place[:, -1]
        ids = out.reshape(-1)[:size]
        # Decoding runs the encoder's steps backwards, so every lane must come back to the state it started from.
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc or (at != ends).any() or (state != LOW).any():
            raise ValueError("token payload is damaged")
        return ids


def plain_pattern() -> re.Pattern:
    """The splitting pattern of the vocabulary file, on text below ``PLAIN_END``."""
    letters, numbers = ("".join(chr(c) for c in range(ord(PLAIN_END)) if unicodedata.category(chr(c))[0] == k) for k in "LN")
    spaces = r"\x09-\x0D\x20\x85\xA0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


class Library:
    """The tokenizers library with a memory of words and pre-tokens.

    No token spans a gap or two pre-tokens, so each is encoded once as long as it
    is remembered. Pre-tokens go straight to the library's BPE model; words beyond
    Latin letters are folded and split by the library's own steps, and words that
    may hold special strings go through the whole library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split, self.shown = plain_pattern(), byte_alphabet()
        self.fold, self.cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = self.tokenizer.model
        self.memory: dict[bytes, bytes] = {}
        self.held = 0

    def _keep(self, key: bytes, ids: bytes) -> bytes:
        if self.held > MEMORY_BYTES:
            self.memory.clear()
            self.held = 0
        self.memory[key] = ids
        self.held += len(key) + len(ids) + ENTRY_BYTES
        return ids

    def word(self, raw: bytes) -> bytes:
        text = raw.decode()
        if "<|" in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return self._keep(raw, np.array(ids, "<u4").tobytes())
        get, piece = self.memory.get, self.piece
        if text.isascii() or (max(text) < PLAIN_END and "İ" not in text):  # nothing to compose, and its classes never change
            low = text.lower()
            found = self.split.findall(low)
            if len(found) == 1 and found[0] == text:  # a small word is its own pre-token
                return piece(raw, text)
            return self._keep(raw, b"".join([get(key) or piece(key, p) for p in found for key in (p.encode(),)]))
        folded = [(b"\n" + p.encode(), p) for p, _ in self.cut(self.fold(text))]
        return self._keep(raw, b"".join([get(key) or self._shown(key, p) for key, p in folded]))

    def piece(self, key: bytes, text: str) -> bytes:
        """Ids of a pre-token."""
        plain = text.isascii() and text.isalnum()  # whose bytes are shown as themselves
        return self._shown(key, text if plain else "".join(map(self.shown.__getitem__, key)))

    def _shown(self, key: bytes, shown: str) -> bytes:
        """Ids of a pre-token, given with a character for each byte."""
        return self._keep(key, array("I", [t.id for t in self.model.tokenize(shown)]).tobytes())

    def parts(self, raw: bytes) -> Iterator[list[bytes]]:
        """Ids of the words of a text, some megabytes of it at a time."""
        at = 0
        while at < len(raw):
            stop = len(raw)
            if stop - at > PART_BYTES:
                stop = raw.find(b" ", at + PART_BYTES) % (len(raw) + 1)
            get, word = self.memory.get, self.word
            yield [get(w) or word(w) for w in raw[at:stop].split()]
            at = stop

    def encode(self, raw: bytes) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return b"".join([b"".join(ids) for ids in self.parts(raw)])

    def count(self, raw: bytes) -> int:
        """Number of ids of a text."""
        return sum([sum(map(len, ids)) for ids in self.parts(raw)]) // 4


_LIBRARIES: dict[str, Library] = {}


def library(path: str) -> Library:
    """The library of this worker for a tokenizer file."""
    if path not in _LIBRARIES:
        _LIBRARIES[path] = Library(path)
    return _LIBRARIES[path]


def _tokens(path: str, end_id: int):
    def run(batches):
        """Ids of a partition's documents, in chunks of whole documents."""
        tokenizer, part = library(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        docs, sizes, ids, held, before = [], [], [], 0, 0

        def chunk():
            return batch_of(TOKENS, [part], [before], [docs], [sizes], [b"".join(ids)])

        for batch in batches:
            names, raws = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for d, packed in zip(names, map(tokenizer.encode, raws), strict=True):
                docs.append(d)
                ids += (packed, end)
                sizes.append(len(packed) // 4 + 1)
                held += sizes[-1]
                if held >= CHUNK:
                    yield chunk()
                    before += held
                    docs, sizes, ids, held = [], [], [], 0
        if docs:
            yield chunk()

    return run


def _histogram(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for packed in batch.column("ids"):
            found = np.bincount(np.frombuffer(packed.as_buffer(), "<u4"))
            if len(found) > len(total):
                total = np.pad(total, (0, len(found) - len(total)))
            total[: len(found)] += found
    used = np.flatnonzero(total)
    yield batch_of(COUNTS, used, total[used])


def _encoded(freq: np.ndarray, offsets: dict[int, int]):
    def run(batches):
        coder = Coder(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u4")
                payload = coder.encode(ids)
                first = offsets[row["part"]] + row["before"]
                yield batch_of(CHUNKS, [first], [len(ids)], [row["docs"]], [row["sizes"]], [payload], [zlib.crc32(payload)])

    return run


def write_tokens(df: DataFrame, path: str, folder: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode documents with a tokenizer file and write a token store in ascending id order.

    Null text is empty; every document ends with ``end_id``. Null ids come last
    and equal ids in an order given by their texts. To the driver come one row
    per id of the vocabulary and one per partition.
    """
    spark = df.sparkSession
    parts = parallelism(df)
    rows = df.select(order_id(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(parts, "d").withColumn("k", F.xxhash64("t")).sortWithinPartitions("d", "k").select("d", "t")
    tokens = stored(ordered.mapInArrow(_tokens(path, end_id), sql(TOKENS)))
    counts = tokens.select("ids").mapInArrow(_histogram, sql(COUNTS)).groupBy("token").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max((r["token"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r["token"]] = r["n"]
    freq = frequencies(total)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    offsets, run = {}, 0
    for part, n in sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum(size)).collect()):
        offsets[part] = run
        run += n
    used = np.flatnonzero(freq)
    table = spark.createDataFrame([(int(i), int(freq[i])) for i in used], "token long, frequency long")
    table.coalesce(1).write.parquet(f"{folder}/frequencies")
    tokens.mapInArrow(_encoded(freq, offsets), sql(CHUNKS)).write.parquet(f"{folder}/chunks")
    drop_stored(spark, tokens)


def read_coder(spark: SparkSession, folder: str) -> np.ndarray:
    """The frequency table of a token store: a row per id of the vocabulary."""
    rows = spark.read.parquet(f"{folder}/frequencies").collect()
    freq = np.zeros(max(r["token"] for r in rows) + 1, np.int64)
    for r in rows:
        freq[r["token"]] = r["frequency"]
    return freq


def _decoded(freq: np.ndarray, with_ids: bool):
    def run(batches):
        coder = Coder(freq)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["crc32"]:
                    raise ValueError("a chunk does not match its checksum")
                ids = coder.decode(row["payload"]).astype("<u4")
                ends = np.cumsum(row["sizes"])
                cut = [ids[a:b].tobytes() for a, b in zip((ends - row["sizes"]).tolist(), ends.tolist(), strict=True)]
                columns = [row["docs"], (row["first_token"] + ends - row["sizes"]).tolist(), row["sizes"], list(map(zlib.crc32, cut))]
                if with_ids:
                    yield batch_of(pa.schema([*INDEX, ("ids", pa.binary())]), *columns, cut)
                else:
                    yield batch_of(INDEX, *columns)

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of a token store: d, start, n_tokens, ids_crc32 and, if asked for, its ids. Chunks decode in parallel."""
    made = sql(INDEX) + (", ids binary" if with_ids else "")
    return spark.read.parquet(f"{folder}/chunks").mapInArrow(_decoded(read_coder(spark, folder), with_ids), made)


def token_index(df: DataFrame, path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write a token store to the shared folder and return doc_id, start, n_tokens and ids_crc32 as read from it."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    write_tokens(df, path, folder, end_id, text, doc_id)
    name = F.when(F.col("d") != LAST_ID, F.col("d")).cast(df.schema[doc_id].dataType).alias(doc_id)
    return read_tokens(spark, folder).select(name, "start", "n_tokens", "ids_crc32")
