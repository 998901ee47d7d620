"""Token counts of documents from the piece counts of distinct pre-tokens.

Tasks note each block of documents as postings: which pre-tokens a document
holds, how often. Distinct pre-tokens of all blocks meet in buckets, where each
is counted once; counts go back to their blocks and are summed per document.
No ids are kept and no text is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, batch_of, parallelism

#: A pre-token is a run of spaces or one line break, with the word after it. No piece of the vocabulary spans two.
PRE_TOKEN = re.compile(rb" +[^ \n]*|\n[^ \n]*")
#: The same in a list of pre-tokens, each closed by a line break.
LISTED = re.compile(rb"( +[^ \n]*|\n[^ \n]*)\n")
#: What the model puts for a space; in a text it means the same.
SPACE_MARK = "▁".encode()
BLOCK_BYTES = 16 << 20
_MODELS: dict[str, sentencepiece.SentencePieceProcessor] = {}


def model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _MODELS:
        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def check_model(path: str) -> None:
    """Fail for vocabularies with pieces that span pre-tokens or whose spaces are not marked in front."""
    sp = model(path)
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if "\n" in piece or "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {i} spans pre-tokens")
    if len(sp.encode(" ")) != 1 or sp.encode("a") == sp.encode(" a"):
        raise ValueError("the model must mark a space in front of texts and keep all spaces")


def pre_tokens(raw: bytes) -> list[bytes]:
    """Pre-tokens of a text, which gets a space in front; none for an empty text."""
    return PRE_TOKEN.findall(b" " + raw.replace(SPACE_MARK, b" ")) if raw else []


def listed(units) -> bytes:
    return b"".join([u + b"\n" for u in units])


def piece_counts(units: list[bytes], path: str) -> list[int]:
    """Pieces of each pre-token as the library gives them inside a text."""
    # The library puts a space in front, which stands for the first space of a unit and is none of a line break's.
    texts = [(u[1:] if u[:1] == b" " else u).decode() for u in units]
    counted = map(len, model(path).encode(texts, num_threads=1))
    return [1 if u == b" " else n - (u[:1] == b"\n") for u, n in zip(units, counted, strict=True)]


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**28 in one to four bytes, seven bits a byte, low first."""
    v = values.astype(np.uint32)
    size = 1 + (v >= 1 << 7) + (v >= 1 << 14) + (v >= 1 << 21)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        more = size > k
        part = (v[more] >> np.uint32(7 * k)) & np.uint32(127)
        out[at[more] + k] = part | ((size[more] > k + 1).astype(np.uint32) << np.uint32(7))
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("docs", pa.list_(pa.int64())),
        ("n_bytes", pa.list_(pa.int64())),
        ("postings", pa.binary()),
        ("units", pa.binary()),
    ]
)
TERMS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("units", pa.binary())])
COUNTS = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
RESULT = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def sql(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}
    kinds |= {pa.list_(kind): f"array<{name}>" for kind, name in kinds.items()}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _blocks(batches):
    """Blocks of documents with their postings; the name of a block is a hash of its documents and texts."""
    docs, sizes, words, held = [], [], [], 0
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    name = xxhash.xxh3_64()

    def close():
        of_doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
        pairs, times = np.unique((of_doc << 32) | np.concatenate(words), return_counts=True)
        each = np.bincount(pairs >> 32, minlength=len(words))
        number = pairs & 0xFFFFFFFF
        step = np.diff(number, prepend=0)
        first = np.cumsum(each) - each
        step[first[each > 0]] = number[first[each > 0]]
        lists = [pack(x) for x in (each, step, times)]
        lead = np.array([len(x) for x in lists], "<i8").tobytes()
        # Lists over the block's documents: how many pre-tokens each holds, their numbers as steps, how often.
        return batch_of(
            BLOCKS, [name.intdigest() >> 1], [docs], [sizes], [lead + b"".join(lists)], [listed(numbers)]
        )

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            units = pre_tokens(raw)
            words.append(np.fromiter(map(numbers.__getitem__, units), np.int64, len(units)))
            docs.append(doc)
            sizes.append(len(raw))
            name.update(f"{doc} {len(raw)} ".encode() + raw)
            held += len(raw) + 64
            if held >= BLOCK_BYTES:
                yield close()
                docs, sizes, words, held = [], [], [], 0
                numbers.clear()
    if docs:
        yield close()


def _terms(buckets: int):
    """Deal the pre-tokens of each block to buckets by their hash."""

    def deal(batches):
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("units").to_pylist(), strict=True):
                units = np.array(LISTED.findall(blob), dtype=object)
                if not len(units):
                    continue
                bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, len(units)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                parts = np.split(order, cuts)
                yield batch_of(
                    TERMS,
                    [int(bucket[p[0]]) for p in parts],
                    [block] * len(parts),
                    [pack(np.diff(p, prepend=0)) for p in parts],
                    [listed(units[p]) for p in parts],
                )

    return deal


def _count(path: str):
    """Count each distinct pre-token of a partition once and answer every block that holds it."""

    def answer(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            found = [LISTED.findall(blob) for blob in batch.column("units").to_pylist()]
            new = list({u for units in found for u in units if u not in known})
            known.update(zip(new, piece_counts(new, path), strict=True))
            counts = [pack(np.fromiter(map(known.__getitem__, units), np.int64, len(units))) for units in found]
            yield batch_of(COUNTS, batch.column("block").cast(pa.int64()), batch.column("places").to_pylist(), counts)

    return answer


def _sum(left: pa.Table, right: pa.Table) -> pa.Table:
    """Token sums of a block's documents. Repeated blocks (same rows read twice) are answered once each."""
    asked, told = right.column("places").to_pylist(), right.column("counts").to_pylist()
    place = np.concatenate([np.cumsum(unpack(x)) for x in asked] or [np.zeros(0, np.int64)])
    count = np.concatenate([unpack(x) for x in told] or [np.zeros(0, np.int64)])
    of_place = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
    of_place[place] = count
    out = []
    for row in left.to_pylist():
        lead = np.frombuffer(row["postings"][:24], "<i8")
        cut = 24 + np.cumsum(lead)
        each, step, times = (unpack(row["postings"][a:b]) for a, b in zip((24, *cut[:-1]), cut, strict=True))
        first = np.cumsum(each) - each
        run = np.cumsum(step)
        # Steps start anew with each document.
        base = np.where(first > 0, run[np.maximum(first - 1, 0)], 0) if len(run) else np.zeros(len(each), np.int64)
        number = run - np.repeat(base, each)
        summed = np.zeros(len(each) + 1, np.int64)
        np.add.at(summed, np.repeat(np.arange(len(each)), each), of_place[number] * times)
        out.append(batch_of(RESULT, row["docs"], row["n_bytes"], summed[:-1].tolist()))
    return pa.Table.from_batches(out, RESULT)


def count_tokens(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and over_limit, for a sentencepiece model.

    Null text is empty and counts 0; null ids and repeated rows pass through.
    """
    check_model(path)
    parts = parallelism(df)
    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    # Both uses below name the same exchange, which runs once.
    blocks = rows.mapInArrow(_blocks, sql(BLOCKS)).repartition(parts, "block")
    terms = blocks.mapInArrow(_terms(4 * parts), sql(TERMS)).repartition(parts, "bucket")
    counts = terms.mapInArrow(_count(path), sql(COUNTS))
    summed = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_sum, sql(RESULT))
    return summed.select(
        F.col("doc").cast(df.schema[doc_id].dataType).alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
