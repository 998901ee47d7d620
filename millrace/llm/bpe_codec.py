"""BPE encoding by per-prefix dynamic programming, and decoding.

Every prefix of a pre-token has one last token in its encoding. A suffix
automaton of the vocabulary finds the tokens that end at each place; of those,
the one whose boundary with the last token of the shorter prefix stands is
stored. Following the stored tokens back gives the ids.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from millrace.llm.common import as_bytes

#: Distinct words, and distinct pre-tokens, that a Python worker remembers.
CACHE_ENTRIES = 700_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def codec_pattern() -> regex.Pattern:
    # The splitting pattern of the vocabulary file, as far as lower-case ASCII goes.
    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


class SuffixAutomaton:
    """Generalised suffix automaton over symbol strings; each state knows the strings (tokens) that end in it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the string of ``p`` followed by ``c``, cut out of ``q`` where ``q`` also holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return self._split(last, c, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def add(self, symbols: list[int]) -> None:
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def mark(self, symbols: list[int], value: int) -> None:
        """Note ``value`` at the state of a string that was added; call when all strings are in."""
        state = 0
        for c in symbols:
            state = self.next[state][c]
        self.ends[state].append((len(symbols), value))

    def close(self) -> None:
        """For each state, the tokens that end in it or above it, longest first."""
        for held in self.ends:
            held.sort(reverse=True)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.ends[state] += self.ends[self.link[state]]


class BpeCodec:
    """Encoder and decoder for a tokenizer file of the lower-casing byte-level kind with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.texts = {i: s for s, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        shown = byte_alphabet()
        self.inner = [vocab[c] for c in shown]
        self.final = [vocab[c + self.suffix] for c in shown]
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = whole
            if whole not in self.rank:
                self.rank[whole] = n
                self.parts[whole] = (vocab[a], vocab[b])
        self.symbols: dict[int, list[int]] = {i: [i] for i in (*self.inner, *self.final)}
        automaton = SuffixAutomaton()
        for whole, (a, b) in self.parts.items():  # parts come before what is made of them
            self.symbols[whole] = self.symbols[a] + self.symbols[b]
        for s in self.symbols.values():
            automaton.add(s)
        for token, s in self.symbols.items():
            automaton.mark(s, token)
        automaton.close()
        self.automaton = automaton
        self.fits: dict[int, bool] = {}
        # Text beyond ASCII is folded and split by the tokenizer's own steps, whose Unicode tables are those of its release.
        self.pieces = codec_pattern()
        steps = Tokenizer.from_file(path)
        self.fold, self.cut = steps.normalizer.normalize_str, steps.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(shown)}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.starts = tuple({s[0] for s in self.special})
        self.words: dict[bytes, bytes] = {}
        self.pre_tokens: dict[str, list[int]] = {}

    def stands(self, a: int, b: int) -> bool:
        """Whether the boundary between tokens ``a`` and ``b`` outlives all merges of their joined text.

        Along the boundary lie the right parts of ``a`` and the left parts of
        ``b``, each alive until the merge that swallows it. A merge across the
        boundary happens if its two sides are alive at its turn. At equal turns
        the leftmost goes first: a merge inside ``a`` before the one across,
        the one across before a merge inside ``b``.
        """
        left, end = [], 1 << 60
        t = a
        while True:
            left.append((t, end))
            if t not in self.parts:
                break
            end, t = self.rank[t], self.parts[t][1]
        right, end = [], 1 << 60
        t = b
        while True:
            right.append((t, end))
            if t not in self.parts:
                break
            end, t = self.rank[t], self.parts[t][0]
        held = True
        for x, x_end in left:
            for y, y_end in right:
                whole = self.merged.get((x, y))
                if whole is not None and self.rank[whole] < x_end and self.rank[whole] <= y_end:
                    held = False
        if len(self.fits) > CACHE_ENTRIES:
            self.fits.clear()
        self.fits[a << 20 | b] = held
        return held

    def encode_symbols(self, symbols: list[int]) -> list[int]:
        """Ids of one pre-token, by the last token of every prefix."""
        automaton = self.automaton
        moves, link, length, ends = automaton.next, automaton.link, automaton.length, automaton.ends
        known = self.fits.get
        last, back = [-1], [0]
        state = matched = 0
        for i, c in enumerate(symbols, 1):
            while state and c not in moves[state]:
                state = link[state]
                matched = length[state]
            state = moves[state][c]
            matched += 1
            for size, token in ends[state]:
                if size >= i:
                    if size == i == matched:
                        break
                elif size <= matched:
                    before = last[i - size]
                    fits = known(before << 20 | token)
                    if fits or fits is None and self.stands(before, token):
                        break
            last.append(token)
            back.append(i - size)
        out, i = [], len(symbols)
        while i:
            out.append(last[i])
            i = back[i]
        return out[::-1]

    def pre_token(self, text: str) -> list[int]:
        """Ids of a pre-token, which is given with a character for each byte."""
        ids = self.pre_tokens.get(text)
        if ids is None:
            raw = bytes(map(self.byte_of.__getitem__, text))
            ids = self.encode_symbols([self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]])
            if len(self.pre_tokens) > CACHE_ENTRIES:
                self.pre_tokens.clear()
            self.pre_tokens[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special strings in it become their ids."""
        out: list[int] = []
        found = self.split_special.split(text) if any(c in text for c in self.starts) else [text]
        for part in found:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii() and part.isprintable():
                for piece in self.pieces.findall(part.lower()):
                    out += self.pre_token(piece)
            elif part:
                for piece, _ in self.cut(self.fold(part)):
                    out += self.pre_token(piece)
        return out

    def word(self, raw: bytes) -> bytes:
        """Ids of a word between gaps, as little-endian 32-bit integers; told once per distinct word."""
        packed = self.words.get(raw)
        if packed is None:
            packed = np.asarray(self.encode(raw.decode()), "<u4").tobytes()
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            self.words[raw] = packed
        return packed

    def encode_text(self, raw: bytes) -> bytes:
        """Ids of a whole text. No token spans a gap, so words are encoded apart."""
        return b"".join(map(self.word, raw.split()))

    def decode(self, ids) -> str:
        return " ".join(map(self.texts.__getitem__, ids))


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The codec of a file, made once per Python worker."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def encode_documents(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: id, n_tokens, ids (binary, little-endian 32-bit) and decoded text. No shuffle.

    Null text is empty and has no tokens; null ids, repeated rows and ties pass through.
    """
    made = f"{_sql_name(doc_id)} {df.schema[doc_id].dataType.simpleString()}, n_tokens long, ids binary, decoded string"
    return df.select(doc_id, text).mapInArrow(lambda batches: _encoded(batches, path, False), made)


def digest_documents(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``encode_documents`` with SHA-256 of ids and of decoded text in their stead, so that no ids leave the task."""
    made = f"{_sql_name(doc_id)} {df.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(doc_id, text).mapInArrow(lambda batches: _encoded(batches, path, True), made)


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _encoded(batches, path: str, digest: bool):
    bpe = codec(path)
    for batch in batches:
        sizes, ids, decoded = [], [], []
        for raw in as_bytes(batch.column(1)):
            packed = bpe.encode_text(raw)
            text = bpe.decode(np.frombuffer(packed, "<u4").tolist())
            sizes.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest() if digest else packed)
            decoded.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
        names = [batch.schema.names[0], "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.string() if digest else pa.binary()), pa.array(decoded, pa.string())],
            names=names,
        )
