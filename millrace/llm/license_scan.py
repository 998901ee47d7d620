"""Licence scan: matching statistics against a suffix automaton of licence words, chained into template spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.bpe_codec import SuffixAutomaton, _sql_name
from millrace.llm.common import as_bytes

# Phrases that decide by themselves, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening words of public licence notices, with their labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
    "with the license you may obtain a copy of the license at",
    "apache-notice": "licensed under the apache license version 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction",
    "mit-notice": "released under the mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license as published by the free software foundation",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: Bytes of words: digits, small letters and all of other scripts; capitals are lowered, the rest are gaps.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


class LicenseIndex:
    """Suffix automaton of all templates and phrases over word numbers.

    Each state knows the phrases that end in its strings and, per template, the
    first place where its strings end.
    """

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], min_run: int, max_gap: int, min_cover: float, min_words: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.min_run, self.max_gap, self.min_cover, self.min_words = min_run, max_gap, min_cover, min_words
        automaton = SuffixAutomaton()
        self.phrases = [([self._number(w) for w in p.split()], label) for p, label in phrases.items()]
        self.templates = [([self._number(w) for w in t.split()], label) for label, t in templates.items()]
        for words, _ in self.phrases + self.templates:
            automaton.add(words)
        for k, (words, _) in enumerate(self.phrases):
            automaton.mark(words, k)
        automaton.close()
        places: list[dict[int, int]] = [{} for _ in automaton.link]
        for k, (words, _) in enumerate(self.templates):
            state = 0
            for end, w in enumerate(words, 1):
                state = automaton.next[state][w]
                places[state].setdefault(k, end)
        for state in sorted(range(1, len(places)), key=automaton.length.__getitem__, reverse=True):
            up = places[automaton.link[state]]
            for k, end in places[state].items():
                up[k] = min(end, up.get(k, end))
        self.automaton, self.places = automaton, places

    def _number(self, word: str) -> int:
        return self.numbers.setdefault(word.encode(), len(self.numbers))

    def matches(self, run: list[int], start: int) -> Iterator[tuple[int, int, int]]:
        """Per word of a run of known words: its place, and the state and length of the longest match that ends there."""
        a = self.automaton
        state = matched = 0
        for i, w in enumerate(run):
            while state and w not in a.next[state]:
                state = a.link[state]
                matched = a.length[state]
            state = a.next[state][w]
            matched += 1
            yield start + i, state, matched

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], dict[str, float], list[tuple[str, int, int]]]:
        """Words, base places (start, phrase), best cover by label, and spans (label, first word, end) of a text."""
        words = raw.translate(WORD_BYTES).split()
        get = self.numbers.get
        known = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        inside = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
        base: list[tuple[int, int]] = []
        long: list[tuple[int, int, int]] = []
        for start, stop in inside.reshape(-1, 2).tolist():
            if stop - start < 2:
                continue
            before = (-1, 0, 0)
            for place, state, matched in self.matches(known[start:stop].tolist(), start):
                for size, phrase in self.automaton.ends[state]:
                    if size <= matched:
                        base.append((place - size + 1, phrase))
                if matched <= before[2] and before[2] >= self.min_run:
                    long.append(before)
                before = (place, state, matched)
            if before[2] >= self.min_run:
                long.append(before)
        cover, spans = self._chains(long)
        return len(words), base, cover, spans

    def _chains(self, long: list[tuple[int, int, int]]) -> tuple[dict[str, float], list[tuple[str, int, int]]]:
        """Chain long matches per template: both sides move on, with a gap of ``max_gap`` words at most in the text."""
        chains: dict[int, list[int]] = {}
        best: dict[str, float] = {}
        spans = []

        def settle(k: int) -> None:
            first, end, _, covered = chains.pop(k)
            share = covered / len(self.templates[k][0])
            label = self.templates[k][1]
            best[label] = max(best.get(label, 0.0), share)
            if share >= self.min_cover and covered >= min(self.min_words, len(self.templates[k][0])):
                spans.append((label, first, end))

        for place, state, matched in long:
            for k, end in self.places[state].items():
                first, begin = place - matched + 1, end - matched
                held = chains.get(k)
                if held is not None and (first - held[1] > self.max_gap or end <= held[2]):
                    settle(k)
                    held = None
                if held is None:
                    chains[k] = [first, place + 1, end, matched]
                else:
                    held[3] += end - max(begin, held[2])
                    held[1], held[2] = place + 1, end
        for k in list(chains):
            settle(k)
        return best, sorted(spans, key=lambda x: (x[1], x[0]))


_INDEXES: dict[tuple, LicenseIndex] = {}


def license_index(min_run: int = 3, max_gap: int = 8, min_cover: float = 0.6, min_words: int = 8) -> LicenseIndex:
    key = (min_run, max_gap, min_cover, min_words)
    if key not in _INDEXES:
        _INDEXES[key] = LicenseIndex(PHRASES, TEMPLATES, *key)
    return _INDEXES[key]


def scan_licenses(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_run: int = 3,
    max_gap: int = 8,
    min_cover: float = 0.6,
    min_words: int = 8,
) -> DataFrame:
    """Per document: words, base phrase places, labels, score and template spans. No shuffle.

    ``score`` is the largest share of a template's words that a chain of long
    matches covers, and 1 where a base phrase stands. A template labels the
    document where a chain covers ``min_cover`` of it and ``min_words`` of its
    words, or all words of a shorter one. Null and empty texts have no words, no
    labels and score 0. Every row is scanned by itself: null ids and repeated rows
    stay rows of their own, spans are sorted by first word and label, an empty
    table gives no rows, other columns are ignored.
    """
    made = (
        f"{_sql_name(doc_id)} {df.schema[doc_id].dataType.simpleString()}, n_words long, n_base long, first_word long, "
        "last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first:long,end:long>>"
    )
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        index = license_index(min_run, max_gap, min_cover, min_words)
        for batch in batches:
            rows = []
            for raw in as_bytes(batch.column(1)):
                n, base, cover, spans = index.scan(raw)
                starts = [s for s, _ in base]
                sure = {index.phrases[k][1] for _, k in base}
                more = {label for label, _, _ in spans}
                score = 1.0 if base else max(cover.values(), default=0.0)
                rows.append(
                    (
                        n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(sure)),
                        ",".join(sorted(sure | more)), min(1.0, score), [dict(zip(("label", "first", "end"), s)) for s in spans],
                    )
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            names = [batch.schema.names[0], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return df.select(doc_id, text).mapInArrow(scan, made)
