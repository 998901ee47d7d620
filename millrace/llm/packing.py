"""Best-fit packing of documents into sequences of fixed length, with conflicts.

Documents longer than a sequence fill whole ones; what is left of them, and all
shorter documents, are packed. Bins lie in order of the room they have left and
carry a bitmap of the sources and duplicate clusters in them. The search starts
at the tightest bin with enough room and goes on to the next until one shares
neither source nor cluster with the piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LAST_ID, as_bytes, batch_of, order_id, parallelism, stored
from millrace.llm.minhash_dedup import _groups
from millrace.llm.token_counts import sql
from millrace.llm.token_files import library

#: Documents that are packed together, about.
GROUP = 4096

LENGTHS = pa.schema([("d", pa.int64()), ("k", pa.int64()), ("source", pa.string()), ("cluster", pa.int64()), ("n", pa.int64())])
PLACED = pa.schema(
    [
        ("d", pa.int64()),
        ("piece", pa.int64()),
        ("first_token", pa.int64()),
        ("length", pa.int64()),
        ("g", pa.int64()),
        ("bin", pa.int64()),
        ("place", pa.int64()),
    ]
)


def best_fit(sizes: list[int], marks: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and place of each piece, in the order given. ``marks`` are the bitmaps of what may stand once in a bin."""
    room: list[tuple[int, int]] = []
    held: list[int] = []
    out = []
    for size, mark in zip(sizes, marks, strict=True):
        at = bisect_left(room, (size, -1))
        while at < len(room) and held[room[at][1]] & mark:
            at += 1
        if at < len(room):
            left, chosen = room.pop(at)
        else:
            left, chosen = capacity, len(held)
            held.append(0)
        out.append((chosen, capacity - left))
        held[chosen] |= mark
        if left > size:
            insort(room, (left - size, chosen))
    return out


def _lengths(path: str):
    def run(batches):
        tokenizer = library(path)
        for batch in batches:
            raws = as_bytes(batch.column(3))
            clusters = [xxhash.xxh3_64_intdigest(b" ".join(raw.split()).lower()) - 2**63 for raw in raws]
            yield batch_of(LENGTHS, *batch.columns[:3], clusters, list(map(tokenizer.count, raws)))

    return run


def _pack(capacity: int):
    def run(batches):
        for table in _groups(batches):
            g = table.column("g").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(g)) + 1, [len(g)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                d, sources, clusters, n = (part.column(c).to_pylist() for c in ("d", "source", "cluster", "n"))
                # A bit for each source and each cluster that more than one document of the group has.
                bits: dict[tuple, int] = {}
                for key in [("s", s) for s in sources if s is not None] + [("c", c) for c in clusters]:
                    bits[key] = bits.get(key, 0) + 1
                shared = {key: 1 << i for i, key in enumerate(sorted((k for k, m in bits.items() if m > 1), key=repr))}
                marks = [shared.get(("s", s), 0) | shared.get(("c", c), 0) for s, c in zip(sources, clusters, strict=True)]
                tails = [x % capacity for x in n]
                order = sorted((i for i in range(len(n)) if tails[i]), key=lambda i: (-tails[i], i))
                found = best_fit([tails[i] for i in order], [marks[i] for i in order], capacity)
                rows = [
                    (d[i], n[i] // capacity, n[i] - tails[i], tails[i], int(g[a]), chosen, place)
                    for i, (chosen, place) in zip(order, found, strict=True)
                ]
                free = 1 + max((chosen for chosen, _ in found), default=-1)
                for i, size in enumerate(n):
                    for piece in range(size // capacity):
                        rows.append((d[i], piece, piece * capacity, capacity, int(g[a]), free, 0))
                        free += 1
                    if not size:
                        rows.append((d[i], 0, 0, 0, int(g[a]), None, None))
                yield batch_of(PLACED, *map(list, zip(*rows)))

    return run


def pack_documents(
    df: DataFrame,
    path: str,
    capacity: int = 2048,
    group: int = GROUP,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Per piece: doc_id, piece, first_token, length, pack, bin and place (its offset in the bin).

    ``capacity`` is in tokens of the tokenizer file. Documents are dealt to
    packs by a hash of id and text, about ``group`` to a pack, as many packs as
    the documents need; bins are numbered within a pack. No bin holds two
    documents of one source or of one cluster (equal words but for case). Null
    sources conflict with none. A document without tokens has one row without a
    bin. Null ids and repeated rows are documents of their own.
    """
    parts = parallelism(df)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(order_id(doc_id).alias("d"), F.xxhash64(t).alias("k"), F.col(source).cast("string").alias("source"), t.alias("t"))
    lengths = stored(rows.mapInArrow(_lengths(path), sql(LENGTHS)))
    packs = max(1, -(-lengths.count() // group))
    dealt = lengths.withColumn("g", F.pmod(F.xxhash64("d", "k"), F.lit(packs)))
    dealt = dealt.repartition(parts, "g").sortWithinPartitions("g", "d", "k")
    placed = dealt.mapInArrow(_pack(capacity), sql(PLACED))
    name = F.when(F.col("d") != LAST_ID, F.col("d")).cast(df.schema[doc_id].dataType).alias(doc_id)
    return placed.select(name, "piece", "first_token", "length", F.col("g").alias("pack"), "bin", "place")
