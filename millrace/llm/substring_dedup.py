"""Removal of repeated word windows, found by backward search in FM-indexes of shards.

A shard holds the segments of its anchors. Its index is the Burrows-Wheeler
transform of their word numbers in a wavelet matrix, one bit per word and level,
with counts per 64 bits. Segments are streamed over it from right to left:
each backward step prepends a word to the match, a match of the window's length
is reported, and the interval is widened to the next shorter match to go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.anchors import Windows, mixed, remove_repeats
from millrace.llm.common import word_hashes


class WaveletMatrix:
    """Rank of a symbol before a place, for many places at once."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        here = symbols.astype(np.uint32)
        for shift in range(self.bits - 1, -1, -1):
            ones = (here >> np.uint32(shift)) & np.uint32(1) == 1
            padded = np.zeros((len(ones) // 64 + 1) * 64, np.uint8)
            padded[: len(ones)] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int32)
            self.words.append(words)
            self.before.append(np.concatenate((np.zeros(1, np.int32), counts[:-1])))
            self.zeros.append(int(len(ones) - counts[-1]))
            here = np.concatenate((here[~ones], here[ones]))
        self.begin = self._follow(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _follow(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            word = place >> 6
            low = self.words[level][word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.before[level][word] + np.bitwise_count(low)
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            place = np.where(one, self.zeros[level] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._follow(symbol, place) - self.begin[symbol]


class FmIndex:
    """FM-index of number sequences, each closed by a 0, sorted as far as ``depth`` numbers."""

    def __init__(self, text: np.ndarray, alphabet: int, window: int) -> None:
        self.size, self.window = len(text), window
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        ranks = {1: rank}
        depth = 1
        order = np.argsort(rank, kind="stable")
        while depth < window:
            after = np.zeros(self.size, np.int64)
            after[: self.size - depth] = rank[depth:] + 1
            key = rank * (self.size + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([False], np.diff(key[order]) != 0))
            rank = np.empty(self.size, np.int64)
            rank[order] = np.cumsum(new)
            depth *= 2
            ranks[depth] = rank
        self.order = order
        self.firsts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        self.wavelets = WaveletMatrix(text[order - 1], alphabet)
        self.full = self._groups(ranks, window)
        self.short = self._groups(ranks, window - 1)
        self.short_starts = np.append(np.flatnonzero(np.diff(self.short, prepend=-1)), self.size)

    def _groups(self, ranks: dict[int, np.ndarray], length: int) -> np.ndarray:
        """Number of the group of each row; rows of a group agree in their first ``length`` numbers."""
        if length < 1:
            return np.zeros(self.size, np.int64)
        half = 1 << (length.bit_length() - 1)
        a = ranks[half][self.order]
        b = ranks[half][np.minimum(self.order + length - half, self.size - 1)]
        return np.cumsum(np.concatenate(([0], (np.diff(a) != 0) | (np.diff(b) != 0))))

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelets.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.firsts[symbol] + both[: len(symbol)], self.firsts[symbol] + both[len(symbol) :]

    def matches(self, text: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each place of the streamed pieces ``text[first:stop]``: a row of the index that starts with the
        window there, or -1. All pieces move in step, from their ends to their beginnings."""
        out = np.full(len(text), -1, np.int64)
        live = np.flatnonzero(stop - first >= self.window)
        begin, end = first[live], stop[live].copy()
        place = end.copy()
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        while len(begin):
            lower, upper = self.backward(text[place - 1], low, high)
            found = upper > lower
            place = np.where(found, place - 1, end - 1)
            end = np.where(found, end, end - 1)
            low, high = np.where(found, lower, 0), np.where(found, upper, self.size)
            done = found & (end - place == self.window)
            out[place[done]] = low[done]
            group = self.short[low[done]]
            low[done], high[done] = self.short_starts[group], self.short_starts[group + 1]
            end[done] -= 1
            stay = end - begin >= self.window
            if not stay.all():
                begin, end, place, low, high = begin[stay], end[stay], place[stay], low[stay], high[stay]
        return out


class WordWindows(Windows):
    same_document = False

    def __init__(self, window: int = 13) -> None:
        self.window, self.gram = window, max(1, min(5, window - 1))

    def units(self, raw: bytes) -> list[bytes]:
        return raw.split()

    def grams(self, texts: list[list[bytes]]) -> np.ndarray:
        words = np.concatenate([word_hashes(x) for x in texts])
        n = len(words) - self.gram + 1
        out = words[:n].copy()
        for k in range(1, self.gram):
            out = mixed(out) + words[k : n + k]
        return mixed(out)

    def piece(self, text: list[bytes], first: int, stop: int) -> bytes:
        return b" ".join(text[first:stop])

    def search(self, h, d, start, pieces):
        """Windows that also start in a document of smaller id, by backward search in the index of the batch."""
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
        if not number:
            return of, of
        words = [p.split() for p in number]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.unique(word_hashes([w for x in words for w in x]), return_inverse=True)[1].astype(np.int64) + 1
        ends = np.cumsum(sizes)
        text = np.insert(codes, ends, 0)  # a 0 closes each segment
        first = ends - sizes + np.arange(len(sizes))
        least = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(least, of, d)
        index = FmIndex(text, int(codes.max()) + 1, self.window)
        owner = np.repeat(least, sizes + 1)
        rows = np.flatnonzero(np.diff(index.full, prepend=-1))
        smallest = np.minimum.reduceat(owner[index.order], rows)
        hit = index.matches(text, first, first + sizes)
        # The smallest document of each window of each distinct segment, then of each row.
        counts = sizes - self.window + 1
        each = counts[of]
        row = np.repeat(np.arange(len(of)), each)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        found = hit[first[of[row]] + offset]
        gone = (found >= 0) & (smallest[index.full[found]] < d[row])
        return row[gone], (start[row] + offset)[gone]


MADE = pa.schema([("d", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", pa.binary())])


def _finish(words: list[bytes], gone: np.ndarray):
    kept, at = [], 0
    for a, b in gone.tolist():
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept), gone.astype("<i8").tobytes()


def remove_repeated_words(df: DataFrame, window: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (UTF-8 words joined by one space) and spans.

    Words covered by a window that also starts in a document of smaller id are
    removed; windows are those of the input. ``spans`` packs pairs of word
    places as 64-bit integers. Null text has no words; a null id comes last;
    rows that repeat an id are told apart by text, and equal rows are one
    document with equal results. Words are compared by 64-bit hashes, windows
    by 13 of them.
    """
    return remove_repeats(df, WordWindows(window), _finish, MADE, text, doc_id)
