"""Operator 13 and its trees against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm.registered import QUERIES
from millrace.llm.spelling_variants import KdTree, letter_counts, letters, one_edit, reach, spelling_forms, word_counts

CAPITALS = {i: i + 32 for i in range(65, 91)}


def brute_counts(rows, min_length=7, min_count=2, every=31):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(CAPITALS)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_length and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts, factor=10):
    form, out = {}, []
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
        out.append((w, form[w], None, n, len(found), counts[form[w]] if form[w] else None))
    done = []
    for w, f, _, *rest in out:
        root = w
        while form[root]:
            root = form[root]
        done.append((w, f, root, *rest))
    return sorted(done, key=str)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def invented(rng, n, length=8, alphabet="abcdeé"):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.choice([length - 1, length, length, length + 1]))) for _ in range(n)})


@pytest.mark.parametrize("tight", [True, False])
@pytest.mark.parametrize("leaf", [1, 20])
def test_range_search(tight, leaf):
    """Every vector in reach is in a leaf that is found; trees by cuts put any vector into exactly one leaf."""
    rng = random.Random(leaf)
    words = [w for w in invented(rng, 900) if len(w) == 8]
    points = np.unique(letter_counts(letters([w.encode("latin-1") for w in words])), axis=0)
    tree = KdTree(points, leaf, tight)
    leaves = np.flatnonzero(tree.child < 0)
    assert sorted(np.concatenate([tree.order[tree.first[x] : tree.stop[x]] for x in leaves]).tolist()) == list(range(len(points)))
    assert (tree.stop - tree.first)[leaves].max() <= leaf
    for size in (7, 8, 9):
        asked = letter_counts(letters([w.encode("latin-1") for w in invented(rng, 300, size) if len(w) == size]))
        more, less = reach(size, 8)
        ask, node, inside = tree.search(asked, more, less)
        assert len(set(zip(ask.tolist(), node.tolist()))) == len(ask) < len(asked) * len(leaves) / 2
        got = {(a, p) for a, x in zip(ask.tolist(), node.tolist()) for p in tree.order[tree.first[x] : tree.stop[x]].tolist()}
        for a, v in enumerate(asked.astype(int)):
            step = points.astype(int) - v
            for p in np.flatnonzero((np.maximum(step, 0).sum(1) <= more) & (np.maximum(-step, 0).sum(1) <= less)).tolist():
                assert (a, p) in got
        if not tight and size == 8:
            assert np.bincount(ask[inside], minlength=len(asked)).tolist() == [1] * len(asked)


def test_letter_order():
    rng = random.Random(3)
    for sizes in ((6, 6), (6, 7), (7, 6), (1, 2)):
        a, b = (["".join(rng.choice("ab") for _ in range(s)) for _ in range(400)] for s in sizes)
        got = one_edit(letters([x.encode() for x in a]), letters([x.encode() for x in b]))
        assert got.tolist() == [near(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("cell_words", [1 << 14, 40])
def test_forms(spark, cell_words):
    rng = random.Random(9)
    counts = {w: rng.choice([2, 3, 20, 35, 300, 4000]) for w in invented(rng, 1200)}
    counts |= {"aaaaaaa" + "b" * 300: 2, "aaaaaaa" + "b" * 301: 30, "zzzzzzzzz": 5, "zzzzzzzzy": 50, "zzzzzzzxy": 500, "zzzzzzwxy": 5000}
    df = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in counts.items()], "w binary, n long").repartition(4)
    got = collected(spelling_forms(df, cell_words=cell_words))
    assert got == brute_forms(counts)
    roots = {r[0]: r[2] for r in got}
    assert roots["zzzzzzzzz"] == "zzzzzzwxy"


def test_word_counts(spark, rows, docs, odd, none):
    plain = [r[:2] for r in rows] + [(7, "Ünïtéd×ÀÀ÷ÿ Straßenbahn STRASSENBAHN straßenbahn x" * 3), (8, "caféteria cafÉteria\ncaféteria"), (None, "caféteria " * 2)]
    df = spark.createDataFrame(plain, "doc_id long, text string").repartition(3)
    for every in (None, 3):
        got = {bytes(r.w).decode("latin-1"): r.n for r in word_counts(df, min_length=5, delete_every=every).collect()}
        assert got == brute_counts(plain, 5, 2, every)
    assert {bytes(r.w).decode(): r.n for r in word_counts(odd, delete_every=31).collect()} == brute_counts([tuple(r) for r in odd.collect()])
    assert word_counts(none).count() == 0 and spelling_forms(word_counts(none)).count() == 0


def test_registered_query(spark, tmp_path):
    rng = random.Random(12)
    words = invented(rng, 60, 9, "aeinrst")
    texts = [(i, " ".join(rng.choice(words[: 1 + rng.randrange(60)]).title() for _ in range(400))) for i in range(30)] + [(None, None), (40, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = collected(QUERIES["op13_spelling_variants"](spark, str(tmp_path)))
    assert got == brute_forms(brute_counts(texts))
    assert any(r[1] for r in got)
