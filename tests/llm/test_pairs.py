"""Operators 4, 7, 9 and 10 and the pipeline, against brute force."""

import collections
import random

import numpy as np
import pytest

from corpus_pipeline import STAGES, run
from millrace.llm import embedding_dedup, line_rules, minhash_dedup
from millrace.llm.bpe_codec import codec
from millrace.llm.components import components
from millrace.llm.embedding_dedup import near_vectors
from millrace.llm.minhash_dedup import near_duplicates, shingles
from millrace.llm.packing import best_fit, pack_documents
from millrace.llm.queries import WORD_BPE
from tests.llm.test_repeats import brute_bytes


class Roots(dict):
    def __missing__(self, x):
        return x

    def find(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, x, y):
        a, b = sorted((self.find(x), self.find(y)))
        if a != b:
            self[b] = a


def brute_near(rows, percent=80):
    sets, roots = {}, Roots()
    for d, text in sorted((r[0], r[1]) for r in rows):
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                roots.join(x, y)
    return {d: (len(sets[d]), roots.find(d), roots.find(d) == d) for d in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(50)] + [(7, 7), (500, 499)]
    roots = Roots()
    for a, b in pairs:
        roots.join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()}
    assert got == {x: roots.find(x) for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_short_texts():
    assert len(shingles(b"")) == 0 and len(shingles(b"one two")) == 1 and len(shingles(b"a b c d e")) == 2
    assert shingles(b"A b\tC")[0] == shingles(b"a B c")[0] != shingles(b"a b")[0]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_documents(docs, rows, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == brute_near(rows)


def test_near_chain(spark):
    """Links that only a chain of steps finds: no document of it is near the first."""
    rng, words = random.Random(9), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def planned(monkeypatch, module):
    """Plans of the tables that ``module`` stores from now on."""
    plans = []
    keep = lambda df, f=module.stored: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), f(df))[1]
    monkeypatch.setattr(module, "stored", keep)
    return plans


def test_tables_of_unknown_size_are_not_broadcast_by_near_documents(docs, monkeypatch):
    """Spark takes the 64 keys of a document for one, and a compressed file for the table in memory."""
    plans = planned(monkeypatch, minhash_dedup)
    near_duplicates(docs).collect()
    exploded = [p for p in plans if "Generate explode" in p]
    assert len(exploded) >= 3 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in exploded)
    named = [p for p in plans if "coalesce(component" in p]
    assert named and not any("BroadcastHashJoin" in p for p in named)


def test_tables_of_unknown_size_are_not_broadcast_by_line_rules(spark, monkeypatch):
    plans = planned(monkeypatch, line_rules)
    df = spark.createDataFrame([(i, f"one {i}\ntwo\nthree", "s") for i in range(30)], "doc_id long, text string, source string")
    table = line_rules.line_table(df)
    places = line_rules.frequent_lines(table, 20)
    assert places.count() == 29 * 2
    (exploded,) = [p for p in plans if "Generate explode" in p]
    assert "SortMergeJoin" in exploded and "BroadcastHashJoin" not in exploded
    assert "BroadcastHashJoin" not in places._jdf.queryExecution().sparkPlan().toString()


def test_near_odd(odd, none):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id or -1, r.kept) for r in near_duplicates(odd).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
    assert near_duplicates(none).count() == 0


def brute_vectors(rows, threshold=0.95):
    unit = {}
    for d, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[d] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    roots, links = Roots(), collections.Counter()
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                roots.join(a, b)
                links.update((a, b))
    return {d: (links[d], roots.find(d), roots.find(d) == d) for d, _ in rows}


@pytest.mark.parametrize("block", [256, 4])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(90)]
    rows += [(100 + i, rng.standard_normal(16).tolist()) for i in range(40)]
    rows += [(200, None), (201, [0.0] * 16), (202, [None] * 16), (203, [float("nan")] * 16), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0])]
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    want = brute_vectors(rows)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[d][0] <= want[d][0] for d in want)
    assert {d: g[1:] for d, g in got.items()} == {d: w[1:] for d, w in want.items()}


def test_vectors_empty(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert near_vectors(spark.createDataFrame([], kind)).count() == 0
    some = near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], kind)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in some) == [(-1, 0, True), (1, 0, True), (1, 0, True)]


def hot_cone(n, seed=4):
    """Vectors of mutual cosine 0.8 in 64 dimensions; 2i and 2i + 1 are at 0.955, and there are no other links."""
    rng = np.random.default_rng(seed)
    frame = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    r = unit(rng.standard_normal((n // 2, 63)))
    side = rng.standard_normal(r.shape)
    side = unit(side - (side * r).sum(axis=1)[:, None] * r)
    twin = 0.775 * r + np.sqrt(1 - 0.775**2) * side
    both = np.stack((r, twin), axis=1).reshape(n, 63)
    return np.concatenate((np.full((n, 1), np.sqrt(0.8)), np.sqrt(0.2) * both), axis=1) @ frame


def test_vectors_of_a_hot_cone(spark, monkeypatch):
    """Isolated pairs in a dense range that is much longer than a block."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    m = hot_cone(6000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert all(got[i] in ((0, i), (1, i - i % 2)) for i in range(6000))
    assert sum(links for links, _ in got.values()) >= 0.95 * 6000


def test_vectors_of_a_small_cone_among_many(spark, monkeypatch):
    """A dense group of a fourteenth of the rows keeps its links, though most rows have none."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    m = np.concatenate((hot_cone(600), rng.standard_normal((8000, 64))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert all(got[i] in ((0, i), (1, i - i % 2)) for i in range(600)) and all(got[i] == (0, i) for i in range(600, 8600))
    assert sum(links for links, _ in got.values()) >= 0.9 * 600


def test_neighbours_across_a_border_of_windows_meet(spark, monkeypatch):
    """Every pair less than half a window apart in an order is compared, wherever runs of windows end."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    turn = np.arange(200) * 0.02
    single = spark.createDataFrame([(i, np.array([np.cos(a), np.sin(a)]).tobytes()) for i, a in enumerate(turn)], "id long, v binary")
    ranked = single.selectExpr("0L AS pass", "id", "0L AS role", "id AS place")
    found = embedding_dedup._met_in_windows(ranked, single, np.cos(0.021), 5)
    linked = embedding_dedup.components(found.selectExpr("id AS a", "least AS b")).collect()
    assert {r.component for r in linked} == {0} and len(linked) == 200


def test_copies_of_vectors_count_as_links(spark):
    rows = [(i, [3.0, 4.0] if i < 700 else [3.0, 4.1] if i < 705 else [-1.0, i + 0.0]) for i in range(710)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == brute_vectors(rows)


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(3)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    marks = [1 << rng.randint(0, 5) for _ in range(200)]
    room, held, want = [], [], []
    for size, mark in zip(sizes, marks, strict=True):
        fits = [(room[b], b) for b in range(len(room)) if room[b] >= size and not held[b] & mark]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(100)
            held.append(0)
        want.append((b, 100 - room[b]))
        room[b] -= size
        held[b] |= mark
    assert best_fit(sizes, marks, 100) == want


def check_packing(placed, texts, sources, capacity):
    bpe, bins, pieces = codec(WORD_BPE), collections.defaultdict(list), collections.defaultdict(list)
    for r in placed:
        pieces[r.doc_id].append((r.first_token, r.length))
        if r.bin is not None:
            bins[r.pack, r.bin].append(r)
    assert set(pieces) == set(texts)
    for d, text in texts.items():
        at = 0
        for first, length in sorted(pieces[d]):
            assert first == at
            at += length
        assert at == len(bpe.encode_text((text or "").encode())) // 4
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.place):
            assert r.place == at
            at += r.length
        assert at <= capacity
        named = [sources[r.doc_id] for r in members if sources[r.doc_id] is not None]
        assert len(named) == len(set(named))
        words = [" ".join((texts[r.doc_id] or "").split()).lower() for r in members]
        assert len(words) == len(set(words))


@pytest.mark.parametrize("group", [4096, 9])
def test_packing(docs, odd, none, rows, group):
    placed = pack_documents(docs, WORD_BPE, capacity=100, group=group).collect()
    check_packing(placed, {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}, 100)
    assert pack_documents(none, WORD_BPE).count() == 0
    assert pack_documents(odd.selectExpr("*", "null as source"), WORD_BPE).count() == 7


def brute_rules(text):
    words = [w for w in (text or "").replace("\x1c", "\x1c").encode().split()]
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    n = len(words)
    return (
        n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
        len(covered), n < 20 or 100 * len(covered) > 30 * n,
    )


def test_rules(docs, rows):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in line_rules.with_rules(docs).collect()}
    assert got == {r[0]: brute_rules(r[1]) for r in rows}


def test_frequent_lines_leave_first_and_reject_depleted(spark, odd, none):
    rng = random.Random(8)
    unique = lambda n: " ".join(f"u{rng.randrange(10**9)}x" for _ in range(n))
    line = unique(40)
    rows = [(i, line.upper() if i % 2 else line, "h") for i in range(30)]
    rows += [(30 + i, line + "\n" + unique(30), "h") for i in range(10)] + [(50 + i, unique(30), "h") for i in range(10)]
    rows += [(100, line, "other"), (101, None, None)]
    got = {r.doc_id: (r.n_line_words, r.kept) for r in line_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (0, True) and all(got[i] == (40, False) for i in range(1, 30))
    assert all(got[30 + i] == (40, True) and got[50 + i] == (0, True) for i in range(10))
    assert got[100] == (0, True) and got[101] == (0, False)
    assert line_rules.quality_rules(odd.selectExpr("*", "null as source")).count() == 7
    assert line_rules.quality_rules(none).count() == 0


def test_lines_above_limits_leave_the_text(spark):
    rng = random.Random(11)
    unique = lambda n: " ".join(f"u{rng.randrange(10**9)}x" for _ in range(n))
    line, own = "Visit page 7 of  our site", [unique(30) for _ in range(40)]
    tail = [unique(9) for _ in range(40)]
    rows = [(i, f"{own[i]}\n\n  {line.upper() if i % 2 else line}\n{line}\n tail {tail[i]}\n", "h") for i in range(40)]
    rows += [(50, f"{own[0]}\n{line}", "other"), (51, None, "h")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars int").repartition(3)
    want = {i: f"{own[i]}\n\n tail {tail[i]}\n" if 0 < i < 40 else t for i, t, _ in rows}
    assert {r.doc_id: r.kept_text for r in line_rules.quality_rules(df).collect()} == want
    stage = STAGES[0][1](spark, df, "")
    assert stage.schema == df.schema
    assert {r.doc_id: (r.text, r.n_chars) for r in stage.collect()} == {i: (t, len(t)) for i, t in want.items() if i != 51}


def test_pipeline_takes_out_lines_of_a_few_per_cent_of_a_large_host(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))  # noqa: E731  digits would all read 0
    own = [" ".join(word() for _ in range(25)) for _ in range(1000)]
    often = lambda i: i < 400 and i % 10 == 0  # noqa: E731  40 of 1,000 documents
    rows = [(i, f"{t}\nall rights reserved" if often(i) else f"{t}\nread on" if i >= 980 else t, "h") for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r.text for r in STAGES[0][1](spark, df, "").collect()}
    assert got == {i: own[i] if i and often(i) else t for i, t, _ in rows}  # read on is in 20 documents, which may be


def test_pipeline(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [len(s) for s in STAGES] == [2] * 4
    kept = [r for r in rows if not brute_rules(r[1])[5]]  # no line is in over 20 documents of a host
    near = brute_near(kept)
    kept = [r for r in kept if near[r[0]][2]]
    left = brute_bytes(kept, 100)
    texts = {}
    for r in kept:
        # Texts of this corpus are cut inside characters too, so compare where they are not.
        texts[r[0]] = left[r[0]][3]
    folder = str(tmp_path)
    found = docs
    for _, stage in STAGES[:3]:
        found = stage(spark, found, folder)
        assert found.columns == docs.columns
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) <= set(texts) and all(len(got[d].text.encode()) >= len(t) for d, t in texts.items() if d in got)
    assert all(t == b"" for d, t in texts.items() if d not in got)
    assert all(r.n_chars == len(r.text) for r in got.values())
    placed = run(spark, folder).collect()
    check_packing(placed, {d: r.text for d, r in got.items()}, {d: r.source for d, r in got.items()}, 2048)


def test_lines_count_documents_not_rows(spark):
    """Repeated rows of an id are one document; a line in 11 documents of a large host goes; a document it fills is depleted."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    own = [" ".join(word() for _ in range(25)) for _ in range(300)]
    boiler = " ".join(word() for _ in range(30))
    rows = [(1, own[0] + "\ntwice told", "h")] * 25 + [(2, own[1] + "\ntwice told", "h")]
    rows += [(10 + i, t if i >= 11 else f"{t}\n{boiler}" if i < 10 else boiler, "h") for i, t in enumerate(own[2:])]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, source string, gone int, places int, __x int, line_o int, `a.b` int")
    out = line_rules.quality_rules(df, limit_documents=10)
    assert out.columns[:8] == df.columns
    got = {r.doc_id: (r.n_line_words, r.kept, r.base_failed, r.gone, r.places, r["__x"], r.line_o, r["a.b"]) for r in out.collect()}
    assert out.count() == len(rows) and got[1][:2] == got[2][:2] == (0, True)
    assert all(got[10 + i][:2] == ((30 if 0 < i < 11 else 0), i != 10) for i in range(298)) and not got[20][2]
    assert {x[3:] for x in got.values()} == {(1, 2, 3, 4, 5)}
