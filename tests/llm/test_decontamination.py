"""Operator 11 and its index against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm.decontamination import SHARD_WORDS, Phrases, ShardIndex, benchmark_hits, sorted_suffixes
from millrace.llm.registered import QUERIES

CAPITALS = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(CAPITALS))


def brute(rows, items, window):
    """doc_id, n_words, n_hit, spans, items of each (doc_id, text)."""
    phrases = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            phrases.setdefault(tuple(words[i : i + size]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text in rows:
        words, hit, found = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                owners = phrases.get(tuple(words[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    found |= owners
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        ends = [i + 1 for i in sorted(hit) if i + 1 not in hit]
        out.append((doc, len(words), len(hit), list(zip(starts, ends)), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def hits(df, benchmark, **options):
    found = benchmark_hits(df, benchmark, **options).collect()
    return sorted(((r[0], r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in found), key=str)


@pytest.fixture(scope="module")
def items(rows):
    """Passages of the corpus with other case and marks, short and repeated items, items without words, text or id."""
    texts = {r[0]: r[1] for r in rows}
    some = [t for _, t in sorted(texts.items()) if t and len(t.split()) > 40]
    out = [(i, "; ".join(some[i].upper().split()[5 : 9 + 4 * i])) for i in range(8)]
    out += [(8, "Three little WORDS!"), (9, ""), (10, None), (11, "--- ..."), (2, out[3][1]), (None, "one"), (12, "nowhere to be found " * 5)]
    return out


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").repartition(3)


@pytest.mark.parametrize("alphabet", [2, 5, 300])
def test_suffixes_and_places(alphabet):
    rng = np.random.default_rng(alphabet)
    text = rng.integers(1, alphabet, 4000)
    text[rng.random(4000) < 0.01] = 0
    text[1000:1700] = text[2000:2700]  # a long repeat
    text[-1] = 0
    order = sorted_suffixes(text, alphabet)
    zeros = np.flatnonzero(text == 0)
    runs = [(tuple(text[i : zeros[np.searchsorted(zeros, i)]]) + (0,), i) for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=runs.__getitem__)
    index = ShardIndex(text, alphabet)
    assert index.locate(np.arange(len(text))).tolist() == order.tolist()
    assert len(index.places) < len(text) / 8


def test_windows_are_found():
    rng = random.Random(4)
    words = [b"w%d" % rng.randint(0, 5) for _ in range(3000)]
    pieces = [("a", b" ".join(words[100:130])), ("b", b"w1 w2"), ("c", b"w1 w2 w3 w4 w5 w0 w1"), (None, b"w9"), ("d", b"x y z")]
    phrases = Phrases(pieces, 6)
    text = [words[:1500], words[1500:], [b"x", b"y"], [], [b"w9"]]
    got = [(int(s), int(w)) for start, which in phrases.hits([phrases.codes(t) for t in text]) for s, w in zip(start, which)]
    joined = sum([t + [None] for t in text], [])
    names = {number: word for word, number in phrases.numbers.items()}
    want = []
    for w, (codes, size) in enumerate(zip(phrases.windows.tolist(), phrases.sizes.tolist())):
        told = [names[c] for c in codes if c]
        want += [(i, w) for i in range(len(joined)) if joined[i : i + size] == told]
    assert len(got) == len(set(got)) and sorted(got) == sorted(want)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_documents(docs, rows, benchmark, items, block_bytes):
    got = hits(docs, benchmark, block_bytes=block_bytes)
    assert got == brute([r[:2] for r in rows], items, 10)
    assert sum(x[2] > 0 for x in got) > 10


def test_odd_rows(spark, odd, none, benchmark):
    items = [(1, "on and on so that windows of thirteen words and a"), ("x", "SHORT")]
    told = spark.createDataFrame([(str(a), b, "t", 1) for a, b in items], "item_id string, text string, d string, items int")
    want = brute([tuple(r) for r in odd.collect()], items, 10)
    assert hits(odd, told) == want == hits(odd, told, block_bytes=10)
    assert [x[2] for x in hits(odd, told.limit(0))] == [0] * 7
    assert hits(none, told) == [] and hits(none, benchmark, block_bytes=100) == []


def test_document_longer_than_a_shard(spark):
    rng = random.Random(8)
    passage = "the passage that lies across the border of two shards of words"
    words = [f"a{rng.randint(0, 9)}" for _ in range(SHARD_WORDS + 5000)]
    for at in (SHARD_WORDS - 16, SHARD_WORDS - 10, SHARD_WORDS + 3000):
        words[at : at + 12] = passage.split()
    df = spark.createDataFrame([(1, " ".join(words)), (2, passage.upper())], "doc_id long, text string")
    told = spark.createDataFrame([(5, passage), (6, "a1 a2 a3 a4 a5 a6")], "item_id int, text string")
    assert hits(df, told) == brute([(1, " ".join(words)), (2, passage)], [(5, passage), (6, "a1 a2 a3 a4 a5 a6")], 10)


def test_registered_query(spark, docs, rows, benchmark, items, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["op11_benchmark_decontamination"](spark, str(tmp_path)).collect()
    sha = lambda found: hashlib.sha256(",".join(found).encode()).hexdigest()
    want = [(d, n, hit, len(found), sha(found), hit > 0) for d, n, hit, _, found in brute([r[:2] for r in rows], items, 10)]
    assert sorted(map(tuple, got)) == sorted(want)
