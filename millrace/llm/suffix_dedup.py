"""Removal of repeated byte strings by suffix sorting with hash comparisons.

The suffixes of a shard's segments are sorted as far as the window. Two
suffixes are compared by their common extension, which binary search finds on
prefix polynomial hashes, so a comparison takes a logarithmic number of steps.
Neighbours that agree over the whole window are compared byte by byte before
they count as equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.anchors import Windows, mixed, remove_repeats

#: Base of the polynomial hashes, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


class HashedSuffixes:
    """Places of a byte text, compared over at most ``window`` bytes by prefix hashes."""

    def __init__(self, text: np.ndarray, window: int) -> None:
        self.text, self.window = text, window
        self.power = np.full(len(text) + 1, BASE, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.prefix = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.prefix[1:])

    def agree(self, a: np.ndarray, b: np.ndarray, length) -> np.ndarray:
        """Whether the hashes of ``length`` bytes at ``a`` and ``b`` agree, brought to one power by multiplication."""
        left = (self.prefix[a + length] - self.prefix[a]) * self.power[b]
        return left == (self.prefix[b + length] - self.prefix[b]) * self.power[a]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.window, np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.agree(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at ``a`` comes before, with or after the one at ``b``."""
        out = np.zeros(len(a), np.int8)
        differ = np.flatnonzero(~self.agree(a, b, self.window))
        if len(differ):
            x, y = a[differ], b[differ]
            reach = self.extension(x, y)
            same = reach == self.window  # only where hashes collide
            reach[same] = 0
            order = np.sign(self.text[x + reach].astype(np.int16) - self.text[y + reach].astype(np.int16))
            order[same] = 0
            out[differ] = order
        return out

    def sort(self, places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stable order of the suffixes within their groups, and for each but the first whether it equals the one before.

        Runs start from the group and the first eight bytes; runs that are not
        in order yet are merged bottom up, each element finding its place in
        the other half by binary search.
        """
        head = np.lib.stride_tricks.sliding_window_view(self.text, 8)[places] if self.window >= 8 else None
        first = head.copy().view(">u8").ravel().astype(np.uint64) if head is not None else np.zeros(len(places), np.uint64)
        order = np.lexsort((first, group))
        key_change = (np.diff(group[order]) != 0) | (np.diff(first[order]) != 0)
        tie = np.concatenate(([False], ~key_change))
        ordered = np.ones(len(order), bool)
        equal = np.zeros(len(order), bool)
        rows = np.flatnonzero(tie)
        sign = self.compare(places[order[rows - 1]], places[order[rows]])
        equal[rows] = sign == 0
        ordered[rows] = sign <= 0
        run = np.cumsum(~tie) - 1
        begins = np.flatnonzero(~tie)
        wrong = np.unique(run[~ordered])
        if len(wrong):
            sizes = np.diff(np.append(begins, len(order)))
            self._merge(places, order, begins[wrong], sizes[wrong])
            again = rows[np.isin(run[rows], wrong)]
            equal[again] = self.compare(places[order[again - 1]], places[order[again]]) == 0
        self._verify(places, order, equal, run, begins)
        return order, equal

    def _merge(self, places: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        at = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        start, length = np.repeat(begin, size), np.repeat(size, size)
        width = 1
        while (length > width).any():
            busy = length > width
            at, start, length = at[busy], start[busy], length[busy]
            rel = at - start
            low = start + rel // (2 * width) * (2 * width)
            end = start + length
            middle, high = np.minimum(low + width, end), np.minimum(low + 2 * width, end)
            left = at < middle
            a, b = np.where(left, middle, low), np.where(left, high, middle)
            other = a.copy()
            mine = places[order[at]]
            open_ = np.flatnonzero(a < b)
            while len(open_):
                probe = (a[open_] + b[open_]) >> 1
                sign = self.compare(places[order[probe]], mine[open_])
                go = np.where(left[open_], sign < 0, sign <= 0)
                a[open_] = np.where(go, probe + 1, a[open_])
                b[open_] = np.where(go, b[open_], probe)
                open_ = open_[a[open_] < b[open_]]
            own = np.where(left, at - low, at - middle)
            to = low + own + a - other
            order[to] = order[at].copy()
            width *= 2

    def _verify(self, places, order, equal, run, begins) -> None:
        """Compare neighbours of equal hash byte by byte; runs with a collision are sorted by their bytes."""
        rows = np.flatnonzero(equal)
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.window)
        bad: list[np.ndarray] = []
        for cut in range(0, len(rows), 1 << 16):
            part = rows[cut : cut + (1 << 16)]
            same = (view[places[order[part - 1]]] == view[places[order[part]]]).all(axis=1)
            bad.append(part[~same])
        for r in np.unique(run[np.concatenate(bad)]).tolist() if rows.size else []:
            a = int(begins[r])
            b = int(begins[r + 1]) if r + 1 < len(begins) else len(order)
            members = sorted(order[a:b].tolist(), key=lambda i: (view[places[i]].tobytes(), i))
            order[a:b] = members
            for j in range(a + 1, b):
                equal[j] = view[places[order[j - 1]]].tobytes() == view[places[order[j]]].tobytes()


class ByteWindows(Windows):
    same_document = True

    def __init__(self, window: int = 100) -> None:
        if window < 32:
            raise ValueError("windows of under 32 bytes are not supported")
        self.window, self.gram = window, 24

    def units(self, raw: bytes) -> bytes:
        return raw

    def grams(self, texts: list[bytes]) -> np.ndarray:
        joined = b"".join(texts)
        eight = np.ndarray((len(joined) - 7,), "<u8", joined, 0, (1,))
        n = len(joined) - self.gram + 1
        out = eight[:n] * np.uint64(0x94D049BB133111EB)
        out = mixed(out) + eight[8 : n + 8]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out = mixed(out) + eight[16 : n + 16]
        return mixed(out * np.uint64(0xA0761D6478BD642F))

    def piece(self, text: bytes, first: int, stop: int) -> bytes:
        return text[first:stop]

    def search(self, h, d, start, pieces):
        """Windows that equal an earlier one: all but the first of each class of equal suffixes, in order of document and place."""
        order = np.lexsort((start, d))
        number: dict[bytes, int] = {}
        first_row: list[int] = []
        repeats: list[int] = []
        for r in order.tolist():
            if number.setdefault(pieces[r], len(first_row)) == len(first_row):
                first_row.append(r)
            else:
                repeats.append(r)
        if not first_row:
            none = np.zeros(0, np.int64)
            return none, none
        sizes = np.fromiter(map(len, number), np.int64, len(number))
        counts = sizes - self.window + 1
        text = np.frombuffer(b"".join(number), np.uint8)
        begins = np.cumsum(sizes) - sizes
        rows = np.array(first_row)
        owner = np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        # Suffixes are numbered in order of document and place, so the first of a class is the earliest.
        by_place = np.lexsort((offset + start[rows][owner], d[rows][owner]))
        owner, offset = owner[by_place], offset[by_place]
        group = np.unique(h[rows], return_inverse=True)[1][owner]
        suffixes = HashedSuffixes(text, self.window)
        sorted_, equal = suffixes.sort(begins[owner] + offset, group)
        later = sorted_[equal]
        extra = np.array(repeats, np.int64)
        more = (np.array([len(pieces[r]) for r in repeats], np.int64) - self.window + 1) if repeats else extra
        more_row = np.repeat(extra, more)
        more_offset = np.arange(len(more_row)) - np.repeat(np.cumsum(more) - more, more)
        row = np.concatenate((rows[owner[later]], more_row))
        return row, start[row] + np.concatenate((offset[later], more_offset))


MADE = pa.schema(
    [
        ("d", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept", pa.binary()),
        ("spans", pa.binary()),
    ]
)


def _finish(raw: bytes, gone: np.ndarray):
    kept, at = [], 0
    for a, b in gone.tolist():
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    left = b"".join(kept)
    return len(raw), len(raw) - len(left), len(gone), left, gone.astype("<i8").tobytes()


def remove_repeated_bytes(df: DataFrame, window: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes) and spans.

    Bytes covered by a string of ``window`` bytes that also starts earlier
    (smaller id, or the same document further in front) are removed; strings
    are those of the input and never cross documents. ``spans`` packs pairs of
    byte places as 64-bit integers. Null text is empty; a null id comes last;
    rows that repeat an id are told apart by text, and equal rows are one
    document with equal results.
    """
    return remove_repeats(df, ByteWindows(window), _finish, MADE, text, doc_id)


TEXT = pa.schema([("d", pa.int64()), ("kept_text", pa.string())])


def whole_characters(raw: bytes, gone: np.ndarray) -> np.ndarray:
    """Spans without the characters that they hold in part only."""
    out = []
    for a, b in gone.tolist():
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _finish_text(raw: bytes, gone: np.ndarray):
    return (_finish(raw, whole_characters(raw, gone))[3].decode(),)


def without_repeats(df: DataFrame, window: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with repeated strings taken out of the text, in whole characters; documents left empty are dropped.

    What counts as repeated is as in ``remove_repeated_bytes``. Documents that
    were empty before stay.
    """
    others = tuple(c for c in df.columns if c not in (text, doc_id))
    was_empty = F.coalesce(F.col(text), F.lit("")) == ""
    marked = df.withColumn("__empty", was_empty)
    out = remove_repeats(marked, ByteWindows(window), _finish_text, TEXT, text, doc_id, (*others, "__empty"))
    out = out.where(F.col("__empty") | (F.col("kept_text") != "")).withColumn(text, F.col("kept_text"))
    return out.select(df.columns)
