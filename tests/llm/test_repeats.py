"""Operators 1 and 3 and what they are built of, against brute force."""

import random

import numpy as np
import pytest

from millrace.llm import anchors, suffix_dedup
from millrace.llm.substring_dedup import FmIndex, WaveletMatrix, WordWindows, remove_repeated_words
from millrace.llm.suffix_dedup import ByteWindows, HashedSuffixes, remove_repeated_bytes, without_repeats


def brute_words(rows, size):
    texts = sorted((r[0], (r[1] or "").encode().split()) for r in rows)
    first = {}
    for d, w in texts:
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, w in texts:
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for j in range(i, i + size)}
        out[d] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def brute_bytes(rows, size):
    seen, out = set(), {}
    for d, b in sorted((r[0], (r[1] or "").encode()) for r in rows):
        gone = set()
        for i in range(len(b) - size + 1):
            if b[i : i + size] in seen:
                gone.update(range(i, i + size))
            seen.add(b[i : i + size])
        spans = sum(j in gone and j - 1 not in gone for j in range(len(b)))
        out[d] = (len(b), len(gone), spans, bytes(x for j, x in enumerate(b) if j not in gone))
    return out


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 1000)
    matrix = WaveletMatrix(symbols, 37)
    asked, place = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert matrix.rank(asked, place).tolist() == [int((symbols[:p] == s).sum()) for s, p in zip(asked, place, strict=True)]


@pytest.mark.parametrize("window", [2, 5, 13])
def test_backward_search_finds_all_windows(window):
    rng = np.random.default_rng(window)
    text = np.append(rng.integers(0, 4, 400), 0)
    index = FmIndex(text, 5, window)
    asked = np.where(rng.random(300) < 0.02, 4, rng.integers(1, 4, 300))
    asked[50:120] = text[100:170]
    asked[asked == 0] = 3
    hit = index.matches(asked, np.array([0, 150]), np.array([150, 300]))
    held = {tuple(text[i : i + window]) for i in range(len(text) - window + 1)}
    for start, stop in ((0, 150), (150, 300)):
        for i in range(start, stop - window + 1):
            piece = tuple(asked[i : i + window])
            if hit[i] >= 0:
                assert tuple(text[index.order[hit[i]] :][:window]) == piece
            assert (hit[i] >= 0) == (piece in held)


@pytest.mark.parametrize("blind", [False, True])
def test_suffix_sort(monkeypatch, blind):
    """Sorted and told equal as by bytes, also when all hashes collide."""
    if blind:
        monkeypatch.setattr(HashedSuffixes, "agree", lambda self, a, b, n: np.ones(len(a), bool))
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1300], text[2000:2300] = text[0:300], text[0:300]
    places = np.arange(0, 2960)
    group = places % 2
    order, equal = HashedSuffixes(text, 32).sort(places, group)
    raw = text.tobytes()
    keys = [(int(group[i]), raw[places[i] : places[i] + 32]) for i in order]
    assert [k == b for k, b in zip(keys[1:], keys, strict=False)] == equal[1:].tolist()
    assert len(set(keys)) == len(keys) - equal.sum()
    for a, b in zip(range(len(order)), range(1, len(order)), strict=False):
        if equal[b]:
            assert order[a] < order[b]
    if not blind:
        assert keys == sorted(keys)


def test_equal_windows_share_anchors():
    rng = random.Random(4)
    raws = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 900))).encode() for _ in range(20)] + [b"xyz" * 300]
    raws += [raws[3] + raws[5], b"", raws[7]]
    kind = ByteWindows(40)
    seen = {}
    count = 0
    for text, first, size, h in kind.runs(raws):
        for i, a, n, x in zip(text.tolist(), first.tolist(), size.tolist(), h.tolist(), strict=True):
            for j in range(a, a + n):
                assert seen.setdefault(raws[i][j : j + 40], x) == x
                count += 1
    assert count == sum(max(0, len(r) - 39) for r in raws)


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    monkeypatch.setattr(anchors, "BATCH_UNITS", 1 << 10)
    rng = random.Random(5)
    raw = bytes(rng.choice(b"abcdefgh") for _ in range(5000))
    windows = sorted(j for _, first, n, _ in ByteWindows(100).runs([raw]) for a, m in zip(first, n, strict=True) for j in range(a, a + m))
    assert windows == list(range(5000 - 99))


@pytest.mark.parametrize("hot", [2048, 1])
def test_words(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT_ANCHOR", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in remove_repeated_words(docs).collect()}
    assert got == brute_words(rows, 13)


@pytest.mark.parametrize("hot", [2048, 1])
def test_bytes(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT_ANCHOR", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(docs).collect()}
    assert got == brute_bytes(rows, 100)


def test_text_keeps_whole_characters(docs, rows):
    out = without_repeats(docs)
    assert out.columns == docs.columns
    want = brute_bytes(rows, 100)
    texts = {r[0]: r[1] for r in rows}
    got = {r.doc_id: r.text for r in out.collect()}
    for d, (_, n_removed, _, kept) in want.items():
        if not (texts[d] or ""):
            assert (got[d] or "") == ""
        elif d in got:
            assert len(got[d].encode()) >= len(kept)
            assert n_removed or got[d] == texts[d]
        else:
            assert kept == b""


def test_odd_rows(odd, none):
    got = sorted(((r.doc_id or -1), r.n_words, r.n_removed) for r in remove_repeated_words(odd).collect())
    assert got == [(-1, 0, 0), (-1, 24, 24), (1, 24, 0), (1, 24, 0), (2, 24, 24), (3, 1, 0), (3, 1, 0)]
    got = sorted(((r.doc_id or -1), r.n_removed > 0) for r in remove_repeated_bytes(odd).collect())
    assert got == [(-1, False), (-1, True), (1, False), (1, False), (2, True), (3, False), (3, False)]
    assert remove_repeated_words(none).count() == remove_repeated_bytes(none).count() == 0
    assert suffix_dedup.without_repeats(none).count() == 0
    assert WordWindows(3).gram < 3
