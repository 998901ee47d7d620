"""Operator 12 against a manifest built by plain hashing."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle_manifest
from millrace.llm.merkle_manifest import Parent
from millrace.llm.registered import QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up(nodes):
    """All levels of a tree of threes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def walk(levels, i, here):
    proof = []
    for level in levels[:-1]:
        run = list(level[i // 3 * 3 : i // 3 * 3 + 3])
        proof += run[: i % 3] + run[i % 3 + 1 :]
        run[i % 3] = here
        here, i = H(*run), i // 3
    return proof, here


def brute(rows, tampered):
    """Rows are dicts; result rows are sorted."""
    groups = {}
    for r in rows:
        leaf = H(*[field(r[c]) for c in FIELDS])
        groups.setdefault(r["source"], []).append((r["doc_id"] is None, r["doc_id"] or 0, leaf, r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees.append(up([leaf for _, _, leaf, _ in groups[s]]))
    top = up([t[-1][0] for t in trees])
    root, out = top[-1][0] if rows else None, []
    for k, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(groups[s]):
            here = H(*[field(tampered(r) if c == "text" else r[c]) for c in FIELDS])
            low, folded = walk(trees[k], i, here)
            high, folded = walk(top, k, folded)
            out.append((r["doc_id"], leaf, trees[k][-1][0], root, H(*low, *high), folded, folded == root))
    return sorted(out, key=str)


def without_breaks(r):
    flagged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
    return r["text"].replace("\n", "") if flagged and r["text"] is not None else r["text"]


def folded(df, **options):
    broken = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = {"text": F.when(broken, F.translate("text", "\n", ""))}
    return sorted(map(tuple, merkle_manifest.merkle_manifest(df, found=found, **options).collect()), key=str)


def test_resumed_state():
    children = [hashlib.sha256(bytes([i])).digest() for i in range(3)]
    other = hashlib.sha256(b"other").digest()
    for slot in range(3):
        changed = children[:slot] + [other] + children[slot + 1 :]
        assert Parent(children).replaced(slot, other) == Parent(changed).digest != Parent(children).digest
        assert Parent(children).replaced(slot, children[slot]) == Parent(children).digest


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(docs, height):
    rows = [r.asDict() for r in docs.collect()]
    got = folded(docs, height=height)
    assert got == brute(rows, without_breaks)
    assert {x[-1] for x in got} == {True, False}


def test_many_groups_and_odd_rows(spark):
    """A group per row and a hot one, null groups, ids and texts, equal rows, an id with two texts, an empty name."""
    rows = [(i, "a\nb", "en", f"ü{i}", 3) for i in range(23)] + [(100 + i, f"x{i}\n", None, "hot", None) for i in range(40)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (None, "a\n", "en", None, 2)]
    rows += [(1, "a\nb", "en", "ü1", 3), (1, "c", "en", "ü1", 3), (7, "", "en", "", 0), (8, "\n" * 5000 + "é" * 60000, "en", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    want = brute([r.asDict() for r in df.collect()], without_breaks)
    assert folded(df, height=1) == want
    assert folded(df) == want


def test_one_row_and_none(spark, none):
    one = spark.createDataFrame([(2, "a", "en", "s", 1)], "doc_id int, text string, lang string, source string, n_chars long")
    [r] = merkle_manifest.merkle_manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H() and r.verified
    assert merkle_manifest.merkle_manifest(none).collect() == []


def test_any_change_is_seen(docs):
    """A changed column other than the text, and a value that takes the place of a null."""
    out = merkle_manifest.merkle_manifest(docs, found={"lang": F.when(F.col("doc_id") == 3, F.lit("de")), "source": F.when(F.col("doc_id") == 0, F.lit("s"))})
    assert {r.doc_id for r in out.collect() if not r.verified} == {0, 3}


def test_registered_query(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)
    assert got == brute([r.asDict() for r in docs.collect()], without_breaks)
