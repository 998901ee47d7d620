"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One inserted or deleted letter changes one count by one, a replaced letter takes
one count up and one down. So the near words of a word lie, among the words of
its own and of the neighbouring lengths, close around its vector of counts. A
tree over the vectors of one length is searched with many vectors at once; boxes
that ask for more letters than one edit can give or take are left. Words whose
vectors fit are compared letter by letter.

Lengths with many words are cut into cells by the upper levels of a tree made
from a sample. A word lives in one cell and asks in all cells its edits can reach.
All letters are below U+0100, so words travel as one byte a letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, batch_of, drop_stored, stored
from millrace.llm.token_counts import sql

#: Words of a cell, about, and sampled words of one by which lengths are cut into cells.
CELL_WORDS = 1 << 14
CELL_SAMPLE = 64
#: Sampled words that the driver takes in all; with more words cells are cut by fewer.
MOST_SAMPLED = 200_000
SAMPLE_SCALE = 1 << 20
#: Distinct words that a task counts before it tells them.
HELD_WORDS = 200_000
#: Vectors searched and pairs of words compared at once.
ASKED, COMPARED = 1 << 12, 1 << 17
#: The 26 small letters have a count each, all others share six. Letters that share one only make the search wider.
KINDS = 32
KIND = np.array([b - 0x61 if 0x61 <= b <= 0x7A else 26 + b % 6 for b in range(256)])
LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

COUNTED = pa.schema([("w", pa.binary()), ("n", pa.int64())])
ROUTED = pa.schema([("cell", pa.int64()), ("own", pa.bool_()), ("w", pa.binary()), ("n", pa.int64())])
NEAR = pa.schema([("w", pa.binary()), ("n", pa.int64()), ("near", pa.int64()), ("less", pa.int64()), ("best", pa.binary())])


def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as a row of letters each."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(words: np.ndarray) -> np.ndarray:
    rows, length = words.shape
    place = (np.arange(rows) * KINDS)[:, None] + KIND[words]
    counts = np.bincount(place.ravel(), minlength=rows * KINDS).reshape(rows, KINDS)
    return counts.astype(np.int16 if length < 1 << 15 else np.int32)


def reach(asked: int, held: int) -> tuple[int, int]:
    """Letters that one edit adds to and takes from a word of ``asked`` letters to make one of ``held`` letters."""
    return int(held >= asked), int(held <= asked)


class KdTree:
    """K-d tree over vectors of counts, built and searched a level at a time.

    ``tight`` trees bound a child by its vectors; the others by the cuts alone, so
    that their leaves share out all vectors there are.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool = True) -> None:
        size = len(points)
        self.order = np.arange(size)
        far = np.iinfo(points.dtype).max // 2
        low = points.min(0, keepdims=True) if tight and size else np.full((1, points.shape[1]), -far, points.dtype)
        high = points.max(0, keepdims=True) if tight and size else np.full((1, points.shape[1]), far, points.dtype)
        self.low, self.high = low[0].copy(), high[0].copy()
        # Of each node: first child or -1, its vectors; of each child: the dimension that made it, its bounds there before and after.
        self.child, self.first, self.stop = [np.array([-1])], [np.array([0])], [np.array([size])]
        self.bounds = [np.zeros((5, 1), np.int64)]
        first, stop, number, made = np.array([0]), np.array([size]), np.array([0]), 1
        while True:
            big = stop - first > leaf
            first, stop, number, low, high = first[big], stop[big], number[big], low[big], high[big]
            if not len(first):
                break
            row = np.concatenate([self.order[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
            here, counts = points[row], stop - first
            at = np.cumsum(counts) - counts
            wide = here.astype(np.float64)
            mean = np.add.reduceat(wide, at) / counts[:, None]
            spread = np.add.reduceat(wide * wide, at) / counts[:, None] - mean**2
            least, most = np.minimum.reduceat(here, at), np.maximum.reduceat(here, at)
            spread[least == most] = -1
            dim = spread.argmax(1)
            each = np.arange(len(dim))
            cut = np.clip(np.floor(mean[each, dim]).astype(np.int64), least[each, dim], most[each, dim] - 1)
            split = least[each, dim] < most[each, dim]
            if not split.all():  # equal vectors stay together
                keep = np.repeat(split, counts)
                row, here = row[keep], here[keep]
                first, stop, number, low, high = first[split], stop[split], number[split], low[split], high[split]
                dim, cut, counts = dim[split], cut[split], counts[split]
                if not len(dim):
                    break
            owner = np.repeat(np.arange(len(dim)), counts)
            value = here[np.arange(len(here)), dim[owner]].astype(np.int64)
            right = value > cut[owner]
            turn = np.argsort(2 * owner + right, kind="stable")
            row, value = row[turn], value[turn]
            begins = np.cumsum(counts) - counts
            self.order[np.repeat(first - begins, counts) + np.arange(len(row))] = row
            lefts = counts - np.add.reduceat(right.astype(np.int64), begins)
            parts = np.stack((begins, begins + lefts), 1).ravel()
            dims = np.repeat(dim, 2)
            each = np.arange(len(dims))
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            old_low, old_high = low[each, dims].astype(np.int64), high[each, dims].astype(np.int64)
            if tight:
                new_low, new_high = np.minimum.reduceat(value, parts), np.maximum.reduceat(value, parts)
            else:
                cuts, side = np.repeat(cut, 2), each % 2 == 1
                new_low, new_high = np.where(side, cuts + 1, old_low), np.where(side, old_high, cuts)
            low[each, dims], high[each, dims] = new_low, new_high
            child = np.concatenate(self.child)
            child[number] = made + 2 * np.arange(len(number))
            self.child = [child, np.full(len(dims), -1)]
            first, stop = np.stack((first, first + lefts), 1).ravel(), np.stack((first + lefts, stop), 1).ravel()
            self.first.append(first)
            self.stop.append(stop)
            self.bounds.append(np.stack((dims, old_low, new_low, old_high, new_high)))
            number = made + np.arange(len(dims))
            made += len(dims)
        self.child, self.first, self.stop = (np.concatenate(x) for x in (self.child, self.first, self.stop))
        self.bounds = np.concatenate(self.bounds, axis=1)
        self.leaves = np.cumsum(self.child < 0) - 1

    def search(self, asked: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves whose box can be reached from each vector by ``more`` letters added and ``less`` taken at most: numbers of
        the vectors, nodes, and whether the box holds the vector itself."""
        ask = np.arange(len(asked))
        node = np.zeros(len(asked), np.int64)
        up = np.maximum(self.low - asked, 0).sum(1, dtype=np.int64)
        down = np.maximum(asked - self.high, 0).sum(1, dtype=np.int64)
        found = []
        while len(ask):
            fits = (up <= more) & (down <= less)
            ask, node, up, down = ask[fits], node[fits], up[fits], down[fits]
            leaf = self.child[node] < 0
            if leaf.any():
                found.append((ask[leaf], node[leaf], (up + down)[leaf] == 0))
                ask, node, up, down = ask[~leaf], node[~leaf], up[~leaf], down[~leaf]
            ask, up, down = np.repeat(ask, 2), np.repeat(up, 2), np.repeat(down, 2)
            node = np.stack((self.child[node], self.child[node] + 1), 1).ravel()
            dim, old_low, new_low, old_high, new_high = self.bounds[:, node]
            x = asked[ask, dim]
            up += np.maximum(new_low - x, 0) - np.maximum(old_low - x, 0)
            down += np.maximum(x - new_high, 0) - np.maximum(x - old_high, 0)
        none = np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*found))) if found else (none, none, none.astype(bool))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of each pair of rows differ by exactly one inserted, deleted or replaced letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1)[:, ::-1]
    true = np.ones((len(a), 1), bool)
    return (np.concatenate((true, ahead), 1) & np.concatenate((behind, true), 1)).any(1)


class Classes:
    """Words of one length in classes of equal letters, with the vector of each class."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        same = np.sort(words, axis=1)
        _, one, of = np.unique(same.view(f"V{same.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.members = np.argsort(of, kind="stable")
        self.sizes = np.bincount(of, minlength=len(one))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.vectors = letter_counts(words[one])


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the owner and place within it, for so many places of each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def near_pairs(asked: Classes, held: Classes, tree: KdTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words one edit apart: rows of ``asked`` and of ``held``, whose vectors the tree holds. All pairs of a
    word that asks come in one piece."""
    more, less = reach(asked.words.shape[1], held.words.shape[1])
    for at in range(0, len(asked.vectors), ASKED):
        some = asked.vectors[at : at + ASKED]
        ask, node, _ = tree.search(some, more, less)
        owner, place = _expanded(tree.stop[node] - tree.first[node])
        ask, other = ask[owner], tree.order[tree.first[node][owner] + place]
        step = held.vectors[other] - some[ask]
        fits = (np.maximum(step, 0).sum(1) <= more) & (np.maximum(-step, 0).sum(1) <= less)
        ask, other = ask[fits] + at, other[fits]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        total = np.cumsum(asked.sizes[ask] * held.sizes[other])
        for begin in range(0, int(total[-1]) if len(total) else 0, COMPARED):
            pair = np.arange(begin, min(begin + COMPARED, int(total[-1])))
            of = np.searchsorted(total, pair, side="right")
            left, right = np.divmod(total[of] - 1 - pair, held.sizes[other[of]])
            a = asked.members[asked.first[ask[of]] + left]
            b = held.members[held.first[other[of]] + right]
            good = one_edit(asked.words[a], held.words[b])
            found.append((a[good], b[good]))
        yield tuple(map(np.concatenate, zip(*found)))


def _match(table: pa.Table) -> pa.Table:
    """Of each word that asks in a cell: how many of the cell's words are near, and the best of them."""
    own = table.column("own").to_numpy(zero_copy_only=False)
    words, n = np.array(table.column("w").to_pylist(), object), table.column("n").to_numpy()
    order = np.flatnonzero(own)
    order = order[np.argsort(words[order], kind="stable")]  # of equal counts the first word is best
    held, held_n = Classes(letters(words[order].tolist())), n[order]
    tree = KdTree(held.vectors, 1)
    sizes = pc.binary_length(table.column("w")).to_numpy()
    out = []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        near, best = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        for a, b in near_pairs(Classes(letters(words[rows].tolist())), held, tree):
            turn = np.lexsort((b, -held_n[b], a))
            a, b = a[turn], b[turn]
            heads = np.flatnonzero(np.diff(a, prepend=-1))
            near[a[heads]] = np.diff(np.append(heads, len(a)))
            best[a[heads]] = b[heads]
        told = np.flatnonzero((near > 0) | own[rows])
        some = best[told] >= 0
        less = pa.array(-held_n[best[told]], pa.int64(), mask=~some)
        chosen = [words[order[k]] if k >= 0 else None for k in best[told].tolist()]
        out.append(batch_of(NEAR, words[rows[told]].tolist(), n[rows[told]], near[told], less, chosen))
    return pa.Table.from_batches(out, NEAR)


def _routes(trees: dict[int, tuple[int, KdTree]]):
    """Each word to its own cell and to all that hold words it may be near to."""

    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column("w")).to_numpy()
            words, n = np.array(batch.column("w").to_pylist(), object), batch.column("n").to_numpy()
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                vectors = letter_counts(letters(words[rows].tolist()))
                for target in (size - 1, size, size + 1):
                    if target in trees:
                        base, tree = trees[target]
                        ask, node, inside = tree.search(vectors, *reach(size, target))
                        ask = rows[ask]
                        own = inside if target == size else np.zeros(len(ask), bool)
                        yield batch_of(ROUTED, base + tree.leaves[node], pa.array(own), words[ask].tolist(), n[ask])

    return run


def _cells(words: DataFrame, cell_words: int) -> dict[int, tuple[int, KdTree]]:
    """Per length the number of its first cell and the tree that cuts it. A row per length and a bounded sample come to the driver."""
    size = F.length("w")
    counts = {r["size"]: r["n"] for r in words.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
    big = [s for s, n in counts.items() if n > cell_words]
    rate = min(CELL_SAMPLE / cell_words, MOST_SAMPLED / max(1, sum(counts[s] for s in big)))
    chosen: dict[int, list[bytes]] = {}
    if big:
        drawn = F.pmod(F.xxhash64("w"), F.lit(SAMPLE_SCALE)) < int(rate * SAMPLE_SCALE)
        for r in words.where(size.isin(big) & drawn).select("w").collect():
            chosen.setdefault(len(r["w"]), []).append(bytes(r["w"]))
    out, base = {}, 0
    for s in sorted(counts):
        sample = sorted(chosen.get(s, []))
        vectors = letter_counts(letters(sample)) if sample else np.zeros((0, KINDS), np.int16 if s < 1 << 15 else np.int32)
        tree = KdTree(vectors, max(1, int(rate * cell_words)), tight=False)
        out[s] = base, tree
        base += int((tree.child < 0).sum())
    return out


def _counted(min_length: int, delete_every: int | None):
    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def run(batches):
        counts: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            return batch_of(COUNTED, [w.encode("latin-1") for w in counts], list(counts.values()))

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                base = zlib.crc32(name.encode() + b":")
                for word, n in Counter(pattern.findall(raw.translate(LOWERED).decode("utf-8", "replace"))).items():
                    if delete_every:
                        h = zlib.crc32(word.encode(), base)
                        if h % delete_every == 0:
                            if len(word) == min_length:
                                continue
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD_WORDS:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    return run


def word_counts(
    df: DataFrame,
    min_length: int = 7,
    min_count: int = 2,
    delete_every: int | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(w, n): words of letters A-Z (lowered), a-z and U+00C0 to U+00FF, a byte a letter, with their number in all texts.

    Only words of ``min_length`` letters and ``min_count`` places or more. With
    ``delete_every``, a word whose crc32 after the document's id and a colon that
    divides loses the letter at crc32 modulo its length: typing errors to order.
    Tasks count before the shuffle. Null texts have no words; a null id is empty.
    """
    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    counted = rows.mapInArrow(_counted(min_length, delete_every), sql(COUNTED))
    return counted.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def spelling_forms(words: DataFrame, factor: int = 10, cell_words: int = CELL_WORDS) -> DataFrame:
    """Per word (w, n) of ``word_counts``: word, form, root, n, n_near and form_n.

    Near words differ by exactly one inserted, deleted or replaced letter; n_near
    is their number. The form is the near word of largest n, the first in
    code-point order of several, if that n is at least ``factor`` times the word's;
    else null, and form_n with it. The root is where forms lead in the end, the
    word itself without a form. An empty table gives no rows.
    """
    spark = words.sparkSession
    kept = stored(words.select("w", "n"))
    routed = kept.mapInArrow(_routes(_cells(kept, cell_words)), sql(ROUTED))
    found = routed.groupBy("cell").applyInArrow(_match, sql(NEAR))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct("less", "best"))).alias("b")
    judged = found.groupBy("w").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best)
    chosen = F.when(-F.col("b.less") >= F.col("n") * F.lit(factor), F.col("b"))
    formed = stored(judged.select("w", "n", "n_near", chosen["best"].alias("form"), (-chosen["less"]).alias("form_n")))
    drop_stored(spark, kept)
    roots = stored(formed.where("form is not null").select("w", F.col("form").alias("r")))
    while True:  # each round doubles the forms followed; n grows by the factor with each, so chains are short
        ahead = roots.select(F.col("w").alias("r"), F.col("r").alias("next"))
        moved = stored(roots.join(ahead, "r", "left").select("w", F.coalesce("next", "r").alias("r"), F.col("next").isNotNull().alias("on")))
        drop_stored(spark, roots)
        roots = moved.select("w", "r")
        if not moved.where("on").limit(1).count():
            break
    out = formed.join(roots, "w", "left")
    name = lambda c: F.decode(c, "ISO-8859-1")
    return out.select(
        name("w").alias("word"), name("form").alias("form"), name(F.coalesce("r", "w")).alias("root"), "n", "n_near", "form_n"
    )
