"""Bring equal windows of documents together without comparing documents.

A window is a fixed number of units (words or bytes). Its anchor is the
smallest hash of the grams inside it, so equal windows have equal anchors and a
document has one anchor for a run of several windows. Anchors that occur once
rule their windows out. For the others the run's units, a segment, go to the
shard of the anchor, where an index finds the equal windows.

Documents are dealt once to chunks by a hash of their id; the three passes over
their texts read the same exchange. A chunk tells an anchor and a segment once,
so a passage of a third of all documents is a row per chunk. An anchor with
many segments is dealt further, by the hash of each of its windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import LAST_ID, as_bytes, batch_of, order_id, parallelism
from millrace.llm.token_counts import sql

#: Segments of one anchor above which its windows are dealt one by one.
HOT_ANCHOR = 2048
SHARD_BYTES = 4 << 20
#: Units hashed at once, a power of two.
BATCH_UNITS = 1 << 19
COPY, SHARED = 0, 1

ANCHORS = pa.schema([("h", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64())])
SEGMENTS = pa.schema(
    [
        ("h", pa.int64()),
        ("d", pa.int64()),
        ("k", pa.int64()),
        ("chunk", pa.int64()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("seg", pa.binary()),
        ("also", pa.binary()),
    ]
)
SPANS = pa.schema([("chunk", pa.int64()), ("kind", pa.int64()), ("value", pa.int64()), ("spans", pa.binary())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    out = x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Windows:
    """What the passes need to know of a kind of window. Subclasses say what a unit is and how shards are searched."""

    window: int
    gram: int
    same_document: bool  # whether an earlier place in the same document counts

    def units(self, raw: bytes):
        raise NotImplementedError

    def grams(self, texts: list) -> np.ndarray:
        """A hash of the gram at each unit of the joined texts; the last ``gram - 1`` have none."""
        raise NotImplementedError

    def piece(self, text, first: int, stop: int) -> bytes:
        raise NotImplementedError

    def search(self, h: np.ndarray, d: np.ndarray, start: np.ndarray, pieces: list[bytes]):
        """Removed windows of segments: row numbers and window starts, two arrays."""
        raise NotImplementedError

    def runs(self, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of windows with one anchor at one place: text number, first window, number of windows, anchor.

        Texts are joined up to ``BATCH_UNITS``; longer ones are cut into pieces that share no window.
        """
        joined: list = []
        held = 0
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text) - self.window + 1), BATCH_UNITS - self.window):
                piece = text[at : at + BATCH_UNITS - 1] if len(text) >= BATCH_UNITS else text
                if held + len(piece) > BATCH_UNITS:
                    yield self._runs(joined)
                    joined, held = [], 0
                joined.append((i, at, piece))
                held += len(piece)
        if joined:
            yield self._runs(joined)

    def _runs(self, joined: list[tuple]):
        sizes = np.array([len(x) for _, _, x in joined], np.int64)
        total = int(sizes.sum())
        if total < self.window:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        grams = self.grams([x for _, _, x in joined])
        # The place in the low bits: of equal grams the leftmost is the anchor, so equal windows that
        # follow each other closely have anchors at different places.
        grams &= ~np.uint64(BATCH_UNITS - 1)
        grams |= np.arange(len(grams), dtype=np.uint64)
        least = sliding_min(grams, self.window - self.gram + 1)
        begins = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - self.window + 1, 0)
        own = np.flatnonzero(counts)
        edge = np.zeros(total + 1, np.int32)
        np.add.at(edge, begins[own], 1)
        np.add.at(edge, begins[own] + counts[own], -1)
        valid = np.cumsum(edge)[: len(least)] > 0
        change = ~valid
        change[0] = True
        change[1:] |= (least[1:] != least[:-1]) | ~valid[:-1]
        change[begins[own]] = True
        marks = np.flatnonzero(change)
        stops = np.append(marks[1:], len(least))
        real = valid[marks]
        first, stop = marks[real], stops[real]
        which = own[np.searchsorted(begins[own], first, side="right") - 1]
        number = np.array([i for i, _, _ in joined], np.int64)
        offset = np.array([at for _, at, _ in joined], np.int64)
        anchor = (least[first] >> np.uint64(BATCH_UNITS.bit_length() - 1)).astype(np.int64)
        return number[which], first - begins[which] + offset[which], stop - first, anchor


def _texts(kind: Windows, texts: pa.Table, control: pa.Table):
    """Ids, keys and units of a chunk's documents in id order, without exact copies."""
    is_copy = control.column("kind").to_numpy() == COPY
    copies = set(control.column("value").to_numpy()[is_copy].tolist())
    d, k = texts.column("d").to_pylist(), texts.column("k").to_pylist()
    order = sorted((i for i in range(len(d)) if k[i] not in copies), key=lambda i: (d[i], k[i]))
    seen: set[int] = set()
    order = [i for i in order if not (k[i] in seen or seen.add(k[i]))]  # repeated rows are one document
    raws = as_bytes(texts.column("t"))
    return [d[i] for i in order], [k[i] for i in order], [kind.units(raws[i]) for i in order]


def _anchors(kind: Windows) -> Callable:
    def run(texts: pa.Table, control: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return ANCHORS.empty_table()
        _, _, units = _texts(kind, texts, control)
        found = [h for _, _, _, h in kind.runs(units)]
        h, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
        chunk = texts.column("chunk")[0].as_py()
        return pa.Table.from_batches([batch_of(ANCHORS, h, np.full(len(h), chunk), n)], ANCHORS)

    return run


def _segments(kind: Windows) -> Callable:
    def run(texts: pa.Table, control: pa.Table) -> pa.Table:
        if not texts.num_rows or not control.num_rows:
            return SEGMENTS.empty_table()
        kinds, values = control.column("kind").to_numpy(), control.column("value").to_numpy()
        shared = kinds == SHARED
        wanted = values[shared]
        hot = control.column("hot").to_numpy(zero_copy_only=False)[shared]
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        if not len(wanted):
            return SEGMENTS.empty_table()
        chunk = texts.column("chunk")[0].as_py()
        ids, keys, units = _texts(kind, texts, control)
        seen: dict[tuple, int] = {}
        out: list[list] = []
        sure: list[list] = []

        def tell(h: int, i: int, first: int, stop: int) -> None:
            piece = kind.piece(units[i], first, stop)
            before = seen.get((h, piece))
            if before is None:
                seen[h, piece] = len(out)
                out.append([h, ids[i], keys[i], chunk, first, stop, piece, None])
            elif out[before][1] == ids[i] and not kind.same_document:
                # The same windows of the same document share their fate: only their places go along.
                out[before][7] = (out[before][7] or b"") + first.to_bytes(8, "little")
            else:
                sure.append([keys[i], ids[i], keys[i], chunk, first, stop, None, None])
                # The chunk holds the same windows earlier; spans that touch are one.
                if len(sure) > 1 and sure[-2][2] == keys[i] and sure[-2][4] <= first <= sure[-2][5]:
                    sure[-2][5] = max(stop, sure[-2][5])
                    sure.pop()

        for text, first, count, h in kind.runs(units):
            place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            chosen = np.flatnonzero(wanted[place] == h)
            rows = zip(
                text[chosen].tolist(), first[chosen].tolist(), count[chosen].tolist(), h[chosen].tolist(),
                hot[place[chosen]].tolist(), strict=True,
            )
            for i, a, n, key, many in rows:
                if many:
                    for j in range(a, a + n):
                        piece = kind.piece(units[i], j, j + kind.window)
                        tell(xxhash.xxh3_64_intdigest(piece) - 2**63, i, j, j + kind.window)
                else:
                    tell(key, i, a, a + n - 1 + kind.window)
        out += sure
        return pa.Table.from_batches([batch_of(SEGMENTS, *map(list, zip(*out)))] if out else [], SEGMENTS)

    return run


def _spans(chunk: np.ndarray, k: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Merged spans per document, packed as pairs of 64-bit integers."""
    order = np.lexsort((start, k))
    chunk, k, start, stop = chunk[order], k[order], start[order], stop[order]
    cuts = np.flatnonzero(np.diff(k)) + 1
    firsts = np.concatenate(([0], cuts)) if len(k) else np.zeros(0, np.int64)
    pairs = [x.tobytes() for x in np.split(np.stack((start, stop), 1).astype("<i8"), cuts)] if len(k) else []
    return batch_of(SPANS, chunk[firsts], np.full(len(firsts), SHARED), k[firsts], pairs)


def _search(kind: Windows) -> Callable:
    def settle(table: pa.Table) -> pa.RecordBatch:
        h, d, k, chunk, start, stop = (table.column(i).to_numpy() for i in range(6))
        sure = table.column("seg").is_null().to_numpy()
        rows = np.flatnonzero(~sure)
        pieces = table.column("seg").filter(pa.array(~sure)).to_pylist()
        row, window = kind.search(h[rows], d[rows], start[rows], pieces)
        row = rows[row]
        order = np.argsort(row, kind="stable")
        row, window = row[order], window[order]
        extra_row, extra = [row], [window]
        also = table.column("also")
        for r in np.flatnonzero(~also.is_null().to_numpy()).tolist():
            a, b = np.searchsorted(row, (r, r + 1)).tolist()
            if a < b:
                places = np.frombuffer(also[r].as_py(), "<i8")[:, None] + (window[a:b] - start[r])[None, :]
                extra.append(places.ravel())
                extra_row.append(np.full(places.size, r))
        row, window = np.concatenate(extra_row), np.concatenate(extra)
        # Windows that follow each other in a document make one span.
        order = np.lexsort((window, row))
        row, window = row[order], window[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(row)) - 1 if len(firsts) else firsts
        gone = np.flatnonzero(sure)
        at = np.concatenate((row[firsts], gone))
        return _spans(
            chunk[at],
            k[at],
            np.concatenate((window[firsts], start[gone])),
            np.concatenate((window[lasts] + kind.window, stop[gone])),
        )

    def run(batches):
        """Rows come in anchor order; whole anchors are settled together, some megabytes at a time."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > SHARD_BYTES:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield settle(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def union_of(pairs: np.ndarray) -> np.ndarray:
    """Disjoint ascending spans that cover the same places."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    firsts = np.flatnonzero(new)
    return np.stack((pairs[firsts, 0], reach[np.append(firsts[1:], len(pairs)) - 1]), 1)


def _apply(kind: Windows, finish: Callable, made: pa.Schema, carried: int) -> Callable:
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        extra = [f"c{i}" for i in range(carried)]
        if not texts.num_rows:
            return pa.Table.from_arrays(
                [pa.array([], f.type) for f in made] + [texts.column(c) for c in extra], names=[*made.names, *extra]
            )
        copies: set[int] = set()
        spans: dict[int, list[bytes]] = {}
        for which, value, pairs in zip(*(told.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if which == COPY:
                copies.add(value)
            else:
                spans.setdefault(value, []).append(pairs)
        rows = []
        for d, k, raw in zip(texts.column("d").to_pylist(), texts.column("k").to_pylist(), as_bytes(texts.column("t")), strict=True):
            units = kind.units(raw)
            if k in copies:
                gone = np.array([[0, len(units)]] if len(units) >= kind.window else [], np.int64).reshape(-1, 2)
            elif k in spans:
                gone = union_of(np.frombuffer(b"".join(spans[k]), "<i8").reshape(-1, 2))
            else:
                gone = np.zeros((0, 2), np.int64)
            rows.append((None if d == LAST_ID else d, *finish(units, gone)))
        done = batch_of(made, *map(list, zip(*rows)))
        return pa.Table.from_arrays([*done.columns, *(texts.column(c) for c in extra)], names=[*made.names, *extra])

    return run


def remove_repeats(
    df: DataFrame, kind: Windows, finish: Callable, made: pa.Schema, text: str, doc_id: str, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: ``finish(units, removed spans)`` in the columns of ``made`` after the id, then those to carry."""
    parts = parallelism(df)
    t = F.coalesce(F.col(text), F.lit(""))
    extra = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    keyed = df.select(order_id(doc_id).alias("d"), t.alias("t"), *extra).withColumn("k", F.xxhash64("d", "t"))
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("d"), F.lit(4 * parts)))
    names = [f"c{i}" for i in range(len(carry))]
    texts = keyed.select("chunk", "d", "k", "t", *names).repartition(parts, "chunk")
    # Exact copies of a text in a document of smaller id need no search.
    digests = keyed.select("chunk", "d", "k", F.md5("t").alias("m"))
    firsts = digests.groupBy("m").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    copies = digests.join(firsts.select("m", "first"), "m").where("d > first")
    copies = copies.select("chunk", F.lit(COPY).cast("long").alias("kind"), F.col("k").alias("value"))

    def beside(other: DataFrame, fn: Callable, made: str) -> DataFrame:
        """``fn`` on each chunk's texts and its rows of the other table; new column ids keep the sides apart."""
        return texts.groupBy("chunk").cogroup(other.toDF(*other.columns).groupBy("chunk")).applyInArrow(fn, made)

    found = beside(copies, _anchors(kind), sql(ANCHORS))
    places = Window.partitionBy("h")
    shared = found.withColumn("all", F.sum("n").over(places)).where("all > 1")
    shared = shared.select(
        "chunk", F.lit(SHARED).cast("long").alias("kind"), F.col("h").alias("value"), (F.col("all") > HOT_ANCHOR).alias("hot")
    )
    control = copies.withColumn("hot", F.lit(False)).unionByName(shared)
    segments = beside(control, _segments(kind), sql(SEGMENTS))
    dealt = segments.repartition(parts, "h").sortWithinPartitions("h")
    spans = dealt.mapInArrow(_search(kind), sql(SPANS))
    told = spans.unionByName(copies.withColumn("spans", F.lit(None).cast("binary")))
    kinds = "".join(f", {n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True))
    out = beside(told, _apply(kind, finish, made, len(carry)), sql(made) + kinds)
    first, *rest = made.names
    return out.select(
        F.col(first).cast(df.schema[doc_id].dataType).alias(doc_id),
        *rest,
        *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)],
    )
