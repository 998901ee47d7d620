"""Benchmark passages in documents, found by backward search in a compressed index of each shard.

A shard is a run of documents of one task; nothing is shuffled. Its index is the
Burrows-Wheeler transform of the words that benchmarks know, in a wavelet matrix,
with the text place of every ``RATE``-th word and of every first word of a run;
the suffix array it is made from is not kept. All windows of the benchmark are
searched in step from their last words to their first. The rows of a window that
is left are walked back, word by word, to the nearest row whose place is kept.

The benchmark is cut into pieces and brought to the tasks in blocks of bounded
size, each a pass of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.anchors import union_of
from millrace.llm.common import LAST_ID, as_bytes, batch_of, drop_stored, order_id, stored
from millrace.llm.license_scan import WORD_BYTES
from millrace.llm.substring_dedup import WaveletMatrix
from millrace.llm.token_counts import sql

#: Every so many places of the indexed text are kept.
RATE = 16
#: Words of a shard; longer documents are cut into pieces that share all windows.
SHARD_WORDS = 1 << 20
#: Rows of an index that are located at once.
LOCATED = 1 << 18
#: Words of a benchmark piece, and text of the benchmark that goes to the tasks at once.
PIECE_WORDS = 4096
BLOCK_BYTES = 4 << 20

PIECES = pa.schema([("item", pa.string()), ("words", pa.binary())])
FOUND = pa.schema([("d", pa.int64()), ("k", pa.int64()), ("n_words", pa.int64()), ("spans", pa.binary()), ("items", pa.list_(pa.string()))])


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


class Wavelets(WaveletMatrix):
    def preceding(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each row and its rank there."""
        symbol = np.zeros(len(row), np.int64)
        for level in range(self.bits):
            word, bit = self.words[level][row >> 6], (row & 63).astype(np.uint64)
            ones = self.before[level][row >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            one = (word >> bit) & np.uint64(1) == 1
            symbol = 2 * symbol + one
            row = np.where(one, self.zeros[level] + ones, row - ones)
        return symbol, row - self.begin[symbol]


def sorted_suffixes(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of word numbers; a 0 closes a run, and zeros rank by their places.

    The first sort compares as many words as fit in 63 bits. Only suffixes that
    are still tied are sorted again, by the rank of what follows, twice as far
    each time.
    """
    bits = max(1, int(alphabet - 1).bit_length())
    depth, size = max(1, 63 // bits), len(text)
    key = np.zeros(size, np.int64)
    open_ = np.ones(size, bool)
    padded = np.concatenate((text, np.zeros(depth, text.dtype))).astype(np.int64)
    for k in range(depth):
        here = padded[k : k + size]
        open_ &= here != 0
        key = (key << bits) | np.where(open_, here, 0)
    order = np.argsort(key, kind="stable")
    key, open_ = key[order], open_[order]
    new = np.ones(size, bool)
    new[1:] = (key[1:] != key[:-1]) | ~open_[1:]
    starts = np.flatnonzero(new)
    rank = np.empty(size, np.int64)
    rank[order] = starts[np.cumsum(new) - 1]
    tied = np.flatnonzero(~new | np.append(~new[1:], False))
    while len(tied):
        held = order[tied]
        first, rest = rank[held], rank[held + depth]
        again = np.lexsort((rest, first))
        held, first, rest = held[again], first[again], rest[again]
        order[tied] = held
        new = np.ones(len(tied), bool)
        new[1:] = (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])
        rank[held] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tied = tied[~new | np.append(~new[1:], False)]
        depth *= 2
    return order


class ShardIndex:
    """Compressed FM-index of word numbers from 1, each run closed by a 0."""

    def __init__(self, text: np.ndarray, alphabet: int) -> None:
        order = sorted_suffixes(text, alphabet)
        last = text[order - 1]  # the text ends in a 0, which also stands before its first word
        self.size = len(text)
        self.firsts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        self.wavelets = Wavelets(last, alphabet)
        kept = (order % RATE == 0) | (last == 0)
        self.places = order[kept].astype(np.int32)
        padded = np.zeros((self.size // 64 + 1) * 64, np.uint8)
        padded[: self.size] = kept
        self.marks = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)
        self.marked = np.concatenate(([0], counts[:-1]))

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (a row each, flush right) that occur, with their rows of the index: numbers, from and to."""
        live = np.flatnonzero(sizes > 0)
        symbol = windows[live, -1]
        low, high = self.firsts[symbol], self.firsts[symbol + 1]
        done = []
        for step in range(1, windows.shape[1] + 1):
            there = high > low
            live, low, high = live[there], low[there], high[there]
            full = sizes[live] == step
            done.append((live[full], low[full], high[full]))
            live, low, high = live[~full], low[~full], high[~full]
            if not len(live):
                break
            symbol = windows[live, -1 - step]
            both = self.wavelets.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
            low, high = self.firsts[symbol] + both[: len(live)], self.firsts[symbol] + both[len(live) :]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text places of rows: walk back to a kept place and add the steps."""
        out = np.empty(len(row), np.int64)
        asked = np.arange(len(row))
        walked = 0
        while len(asked):
            word, bit = self.marks[row >> 6], (row & 63).astype(np.uint64)
            kept = (word >> bit) & np.uint64(1) == 1
            low = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[asked[kept]] = self.places[(self.marked[row >> 6] + low)[kept]] + walked
            asked, row = asked[~kept], row[~kept]
            symbol, rank = self.wavelets.preceding(row)
            row = self.firsts[symbol] + rank
            walked += 1
        return out


class Phrases:
    """The distinct windows of some benchmark pieces, and the items that hold each."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        names = sorted({item for item, _ in pieces if item is not None})
        number = {item: i for i, item in enumerate(names)}
        self.names = np.array(names, object)
        rows, owners, sizes = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, joined in pieces:
            codes = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in joined.split()], np.int32)
            size = min(window, len(codes))
            if not size:
                continue
            cut = np.lib.stride_tricks.sliding_window_view(codes, size)
            rows.append(np.pad(cut, ((0, 0), (window - size, 0))))
            owners.append(np.full(len(cut), -1 if item is None else number[item]))
            sizes.append(np.full(len(cut), size))
        every = np.concatenate(rows)
        self.windows, of = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, np.int64))
        self.sizes = np.zeros(len(self.windows), np.int64)
        self.sizes[of] = np.concatenate(sizes)
        owner = np.concatenate(owners)
        pairs = np.unique(np.stack((of.ravel(), owner), 1)[owner >= 0], axis=0)
        self.owners = pairs[:, 1]
        self.owned = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 1

    def codes(self, words: list[bytes]) -> np.ndarray:
        get = self.numbers.get
        return np.fromiter((get(w, 0) for w in words), np.int32, len(words))

    def hits(self, pieces: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts of occurring windows in the joined pieces, some at a time, with the numbers of the windows."""
        ends = np.cumsum([len(p) + 1 for p in pieces])
        joined = np.zeros(int(ends[-1]), np.int32)
        for end, p in zip(ends.tolist(), pieces, strict=True):
            joined[end - 1 - len(p) : end - 1] = p
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (joined > 0).view(np.int8), [0])))).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= self.shortest]
        if not len(edges) or not len(self.windows):
            return
        # Runs of known words that are long enough, each with the 0 that follows it.
        sizes = edges[:, 1] - edges[:, 0] + 1
        begins = np.cumsum(sizes) - sizes
        shift = edges[:, 0] - begins
        index = ShardIndex(joined[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)], len(self.numbers) + 1)
        which, low, high = index.search(self.windows, self.sizes)
        total = np.cumsum(high - low)
        for at in range(0, int(total[-1]) if len(total) else 0, LOCATED):
            asked = np.arange(at, min(at + LOCATED, int(total[-1])))
            window = np.searchsorted(total, asked, side="right")
            place = index.locate(high[window] - (total[window] - asked))
            yield place + shift[np.searchsorted(begins, place, side="right") - 1], which[window]


_PHRASES: dict[str, Phrases] = {}


def _phrases(key: str, pieces: list[tuple[str | None, bytes]], window: int) -> Phrases:
    if key not in _PHRASES:
        _PHRASES.clear()
        _PHRASES[key] = Phrases(pieces, window)
    return _PHRASES[key]


def _search(key: str, given: list[tuple[str | None, bytes]], window: int, all_rows: bool):
    def run(batches):
        phrases = _phrases(key, given, window)
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            spans: list[list[np.ndarray]] = [[] for _ in ids]
            items: list[set[int]] = [set() for _ in ids]
            counts = []
            shard: list[tuple[int, int, np.ndarray]] = []
            held = 0

            def settle() -> None:
                begins = np.cumsum([0] + [len(c) + 1 for _, _, c in shard])
                doc = np.array([i for i, _, _ in shard])
                offset = np.array([at for _, at, _ in shard])
                for start, which in phrases.hits([c for _, _, c in shard]):
                    piece = np.searchsorted(begins, start, side="right") - 1
                    first = start - begins[piece] + offset[piece]
                    order = np.lexsort((first, doc[piece]))
                    owner, first, end = doc[piece][order], first[order], (first + phrases.sizes[which])[order]
                    cuts = np.flatnonzero(np.diff(owner)) + 1
                    for i, pairs in zip(owner[np.append(0, cuts)].tolist(), np.split(np.stack((first, end), 1), cuts), strict=True):
                        spans[i].append(union_of(pairs))
                    for i, w in np.unique(np.stack((doc[piece], which), 1), axis=0).tolist():
                        items[i].update(phrases.owners[phrases.owned[w] : phrases.owned[w + 1]].tolist())

            for i, raw in enumerate(as_bytes(batch.column(2))):
                codes = phrases.codes(words_of(raw))
                counts.append(len(codes))
                for at in range(0, max(1, len(codes) - window + 1), SHARD_WORDS - window):
                    piece = codes[at : at + SHARD_WORDS]
                    if shard and held + len(piece) > SHARD_WORDS:
                        settle()
                        shard, held = [], 0
                    shard.append((i, at, piece))
                    held += len(piece)
            if shard:
                settle()
            chosen = [i for i in range(len(ids)) if all_rows or spans[i]]
            yield batch_of(
                FOUND,
                [ids[i] for i in chosen],
                [keys[i] for i in chosen],
                [counts[i] for i in chosen],
                [union_of(np.concatenate(spans[i])).astype("<i8").tobytes() if spans[i] else b"" for i in chosen],
                [phrases.names[sorted(items[i])].tolist() for i in chosen],
            )

    return run


def _pieces(window: int):
    """Items as pieces of words joined by a space; pieces share all but one word of a window with the next."""

    def run(batches):
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for item, raw in zip(names, as_bytes(batch.column(1)), strict=True):
                words = words_of(raw)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    if words:
                        out.append((item, b" ".join(words[at : at + PIECE_WORDS + window - 1])))
            if out:
                yield batch_of(PIECES, *map(list, zip(*out)))

    return run


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _merged(batches):
    """Removal spans of all passes merged, with the words they cover."""
    for batch in batches:
        spans, hit = [], []
        for packed in batch.column("spans").to_pylist():
            pairs = np.frombuffer(packed, "<i8").reshape(-1, 2)
            pairs = union_of(pairs) if len(pairs) else pairs
            hit.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
            spans.append([{"first": a, "end": b} for a, b in pairs.tolist()])
        columns = [batch.column("d"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(spans, SPANS), batch.column("items")]
        yield pa.RecordBatch.from_arrays(columns, names=["d", "n_words", "n_hit", "spans", "items"])


def benchmark_hits(
    df: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``df``: doc_id, n_words, n_hit, spans and items.

    Words are runs of digits, letters a-z (capitals lowered) and all characters
    beyond ASCII. A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. ``spans`` are the disjoint ascending
    spans of words, from first to before end, that occurrences of windows cover,
    n_hit their words; ``items`` the ids, as distinct sorted strings, of the items
    with an occurring window. Null and empty texts have no words. Items without id
    have windows but are not listed; repeated items are one. Repeated rows of
    ``df`` are rows of their own with equal results, null ids stay null. With an
    empty benchmark nothing is hit; an empty ``df`` gives no rows. Other columns
    are ignored, whatever their names.

    The benchmark comes to the driver and the tasks in blocks of about
    ``block_bytes``. The first block's pass needs no shuffle; later ones send only
    documents with hits.
    """
    spark = df.sparkSession
    told = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    pieces = stored(told.mapInArrow(_pieces(window), sql(PIECES)))
    size = pieces.agg(F.sum(F.length("words") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(blocks)))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(order_id(doc_id).alias("d"), F.xxhash64(t).alias("k"), t.alias("t"))
    found, more = None, None
    for b in range(blocks):
        given = [(r["item"], bytes(r["words"])) for r in numbered.where(F.col("block") == b).select("item", "words").collect()]
        hits = rows.mapInArrow(_search(uuid.uuid4().hex, given, window, b == 0), sql(FOUND))
        if found is None:
            found = hits
            continue
        hits = hits.dropDuplicates(["d", "k"]).select("d", "k", "spans", "items")
        more = hits if more is None else more.unionByName(hits)
    drop_stored(spark, pieces)
    if more is not None:
        listed = more.groupBy("d", "k").agg(F.collect_list("spans").alias("s"), F.collect_list("items").alias("i"))
        joined = found.join(listed, ["d", "k"], "left")
        spans = F.aggregate(F.coalesce("s", F.array().cast("array<binary>")), F.col("spans"), lambda a, x: F.concat(a, x))
        items = F.flatten(F.concat(F.array("items"), F.coalesce("i", F.array().cast("array<array<string>>"))))
        found = joined.select("d", "n_words", spans.alias("spans"), F.array_sort(F.array_distinct(items)).alias("items"))
    made = "d long, n_words long, n_hit long, spans array<struct<first:long,end:long>>, items array<string>"
    out = found.select("d", "n_words", "spans", "items").mapInArrow(_merged, made)
    name = F.when(F.col("d") != LAST_ID, F.col("d")).cast(df.schema[doc_id].dataType).alias(doc_id)
    return out.select(name, "n_words", "n_hit", "spans", "items")
