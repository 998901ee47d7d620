"""Operators 2, 5, 6 and 8, against the libraries and brute force."""

import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import license_scan, token_counts, token_files
from millrace.llm.bpe_codec import SuffixAutomaton, codec, encode_documents
from millrace.llm.queries import PIECE_BPE, WORD_BPE

ALPHABET = "aab bc AeéÉ<|>'tsSΣσİ́ \n\x1c\x85\xa0中文12½ǅ!?▁"


def texts(n, seed):
    rng = random.Random(seed)
    out = ["", " ", "\n", "<|startoftext|> a<|endoftext|>", "aaaaaaaaa", "hahahahaha", "x" * 3000]
    for i in range(n):
        if i % 5:
            out.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))))
        else:
            out.append("".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(0x400, 0xD7FF), rng.randint(0xE000, 0x2FFFF)])) for _ in range(6)))
    return out


def test_automaton_ends():
    rng = random.Random(2)
    words = [[rng.randint(0, 2) for _ in range(rng.randint(1, 7))] for _ in range(40)]
    words = [list(x) for x in {tuple(w) for w in words}]
    a = SuffixAutomaton()
    for w in words:
        a.add(w)
    for i, w in enumerate(words):
        a.mark(w, i)
    a.close()
    text = [rng.randint(0, 2) for _ in range(300)]
    state = matched = 0
    for end, c in enumerate(text, 1):
        while state and c not in a.next[state]:
            state = a.link[state]
            matched = a.length[state]
        if c in a.next[state]:
            state, matched = a.next[state][c], matched + 1
        found = {token for size, token in a.ends[state] if size <= matched}
        assert found == {i for i, w in enumerate(words) if len(w) <= end and text[end - len(w) : end] == w}


def test_bpe_equals_library():
    library, own = Tokenizer.from_file(WORD_BPE), codec(WORD_BPE)
    for text in texts(3000, 1):
        ids = np.frombuffer(own.encode_text(text.encode()), "<u4").tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    own = codec(WORD_BPE)
    assert all(own.encode_symbols(s) == [token] for token, s in own.symbols.items())


def test_bpe_documents(docs, odd, none, rows):
    library = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encode_documents(docs, WORD_BPE).collect()}
    assert got == {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    assert encode_documents(odd, WORD_BPE).count() == 7
    assert encode_documents(none, WORD_BPE).count() == 0


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 32768, 70001])
def test_coder_round_trip(size):
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.zipf(1.3, size), 5000) - 1
    coder = token_files.Coder(token_files.frequencies(np.bincount(ids, minlength=1)))
    payload = coder.encode(ids)
    assert (coder.decode(payload) == ids).all()
    if size > 1000:
        broken = bytearray(payload)
        broken[-7] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(broken))


def test_frequencies_keep_every_id():
    counts = np.array([10**12, 0, 1, 1, 5])
    freq = token_files.frequencies(counts, 10)
    assert freq.sum() == 1024 and (freq > 0).tolist() == (counts > 0).tolist()


def test_token_store(spark, docs, odd, none, rows, tmp_path):
    folder = str(tmp_path / "store")
    token_files.write_tokens(docs, WORD_BPE, folder)
    got = {r.d: (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_files.read_tokens(spark, folder, True).collect()}
    library, at = Tokenizer.from_file(WORD_BPE), 0
    for r in sorted(rows):
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert got[r[0]] == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert token_files.token_index(odd, WORD_BPE).count() == 7
    assert token_files.token_index(none, WORD_BPE).count() == 0


def test_packed_numbers():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert token_counts.unpack(token_counts.pack(x)).tolist() == x.tolist()
    assert len(token_counts.unpack(b"")) == 0


def test_piece_counts(spark, docs, odd, none, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    some = texts(1500, 3)
    df = spark.createDataFrame(list(enumerate(some)), "doc_id int, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, PIECE_BPE).collect()}
    assert got == {i: (len(x.encode()), len(sp.encode(x))) for i, x in enumerate(some)}
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PIECE_BPE, limit=100).collect()}
    assert got == {r[0]: (n := len(sp.encode(r[1] or "")), n > 100) for r in rows}
    assert token_counts.count_tokens(odd, PIECE_BPE).count() == 7
    assert token_counts.count_tokens(none, PIECE_BPE).count() == 0


LICENSED = [
    "Licensed under CC BY-NC 4.0. All rights reserved, all rights reserved!",
    "This work is licensed under the GNU General Public License, version 3.",
    "cc cc by by GENERAL public general public license",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this stuff and associated documentation files",
    "the mit license was released under the sea",
    "allérights rights reserved all rights", "", None, "cc", "by cc",
]


def brute_phrases(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [
        (i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
    ]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def brute_matches(words, index):
    """Longest template or phrase substring that ends at each word."""
    held = {tuple(w[i:j]) for w, _ in index.templates + index.phrases for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in held), default=0) for i in range(len(words))]


def test_license_matching_statistics():
    index = license_scan.license_index()
    rng = random.Random(6)
    words = [rng.randrange(len(index.numbers)) for _ in range(50)] + index.templates[0][0][3:20] + index.templates[2][0][5:9]
    assert [m for _, _, m in index.matches(words, 0)] == brute_matches(words, index)


def test_license_scan(spark, docs, odd, none, rows):
    df = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id int, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, text in enumerate(LICENSED):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "mit" in got[3].labels and got[3].base_labels == "" and got[4].labels == ""
    assert {r.doc_id for r in license_scan.scan_licenses(docs).collect()} == {r[0] for r in rows}
    assert license_scan.scan_licenses(odd).count() == 7 and license_scan.scan_licenses(none).count() == 0
