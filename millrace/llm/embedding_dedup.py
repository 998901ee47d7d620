"""Near-duplicate vectors by sorted passes over concatenated random hashes.

Equal vectors are one. A hash of a vector is the number of the nearest of up
to 256 vectors drawn at random, then, inside that cell, the nearest of those
drawn there, and so on, so dense parts of the space are cut as finely as they
are full; signs of random projections follow. Each pass orders all vectors
lexicographically by such hashes of its own and compares neighbours of the
order by cosine, across all borders. One vector in four has a neighbour
planted at the threshold, which only takes a place in the order. After a few
passes over all vectors, the ranges of the order where too many planted
neighbours were not met are hashed again, with centres drawn from them alone,
until no range is left. Every component of the links is then compared whole,
so links within it are complete.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LAST_ID, batch_of, drop_stored, order_id, parallelism, stored
from millrace.llm.components import components
from millrace.llm.minhash_dedup import _groups
from millrace.llm.token_counts import sql

#: Vectors that a window of the order compares; it moves by half of them. Windows that are sent together.
BLOCK = 512
RUN = 8
#: Leaves that should fill a block, and how many times the centres of a pass are drawn: other passes use others.
LEAVES_A_BLOCK = 4
DRAWN = 4
#: Centres beside which a node of a tree chooses, and centres drawn at most, in number and in bytes of the broadcast.
FAN = 256
MOST_CENTRES = 1 << 16
MOST_CENTRE_BYTES = 32 << 20
#: Neighbouring vectors of the first order that are judged together, and the part of them beside which a neighbour is planted.
RANGE = 512
PLANTED = 4
#: Part of a range's planted neighbours that may be left unmet.
MISSED = 0.02
#: Passes over all vectors before the ranges are judged.
PASSES = 4
#: Bits of the offset from the leaf's centre that order a leaf.
BITS = 32

VECTORS = pa.schema([("id", pa.int64()), ("v", pa.binary())])
#: Roles: 0 a vector, 1 a vector beside which one is planted, 2 the planted one, under the id of the former.
KEYS = pa.schema([("pass", pa.int64()), ("key", pa.binary()), ("id", pa.int64()), ("role", pa.int64())])
RANKS = pa.schema([(c, pa.int64()) for c in ("pass", "id", "role", "part", "at")])
FOUND = pa.schema([("id", pa.int64()), ("least", pa.int64())])
EXACT = pa.schema([("id", pa.int64()), ("links", pa.int64())])


def unit_rows(vectors: list) -> list[bytes | None]:
    """Vectors scaled to length 1, as double-precision bytes; none where one is zero, empty or not finite."""
    out: list[bytes | None] = [None] * len(vectors)
    sizes = np.array([len(v) for v in vectors])
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        m = np.array([vectors[i] for i in rows], np.float64)
        top = np.abs(m).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        m = m[good] / top[good, None]  # no overflow when squared
        m /= np.sqrt((m * m).sum(axis=1))[:, None]
        for i, x in zip(rows[good].tolist(), m, strict=True):
            out[i] = x.tobytes()
    return out


def _vectors(batches):
    for batch in batches:
        yield batch_of(VECTORS, batch.column(0), unit_rows(batch.column(1).to_pylist()))


class Tree:
    """Nested nearest-centre cells of unit vectors. Leaves are numbered so that those of one node are neighbours."""

    def __init__(self, centres: np.ndarray, order: np.ndarray):
        self.members: list[np.ndarray] = []  # centres of a node
        self.below: list[np.ndarray] = []  # by centre, the node below, or -1 - leaf
        self.cell: np.ndarray = np.zeros(len(centres), np.int64)  # by centre, the last node above it with many centres
        self.leaves = 0
        self.root = self._grow(centres, order)

    def _grow(self, centres: np.ndarray, held: np.ndarray) -> int:
        chosen = held[:FAN]
        near = (centres[held] @ centres[chosen].T).argmax(axis=1) if len(held) > 1 else np.zeros(len(held), int)
        if len(held) < 2 or (near == near[0]).all():
            self.leaves += 1
            return -self.leaves
        node = len(self.members)
        self.members.append(chosen)
        self.below.append(np.zeros(len(chosen), np.int64))
        if len(held) >= FAN // 8:
            self.cell[held] = node
        for k in range(len(chosen)):
            self.below[node][k] = self._grow(centres, held[near == k])
        return node

    def route(self, centres: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and the last centre chosen (-1 if there is none)."""
        at, last = np.full(len(m), self.root, np.int64), np.full(len(m), -1, np.int64)
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            open_ = open_[np.argsort(at[open_], kind="stable")]
            cuts = np.flatnonzero(np.diff(at[open_])) + 1
            for rows in np.split(open_, cuts):
                node = at[rows[0]]
                near = (m[rows] @ centres[self.members[node]].T).argmax(axis=1)
                last[rows], at[rows] = self.members[node][near], self.below[node][near]
            open_ = open_[at[open_] >= 0]
        return -1 - at, last


def _planes(seed: int, p: int, width: int) -> np.ndarray:
    return np.random.default_rng((seed, p, width)).standard_normal((width, BITS)).astype(np.float32)


def _place(tree: Tree, centres: np.ndarray, m: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf, and the signs of the offset from its centre."""
    leaf, last = tree.route(centres, m)
    offset = m - np.where(last[:, None] >= 0, centres[last], 0) if len(centres) else m
    return leaf, (offset @ planes) > 0


def plant(m: np.ndarray, ids: np.ndarray, tree: Tree, centres: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """A neighbour of each row whose cosine is the threshold.

    It lies halfway between a direction drawn at random and that of a centre
    drawn from the row's cell, so that it stays as deep in a dense group as the
    row itself. Both draws depend on the row's id only.
    """
    side, to = np.empty_like(m), np.zeros_like(m)
    last = tree.route(centres, m.astype(np.float32))[1]
    for k, i in enumerate(ids.tolist()):
        rng = np.random.default_rng((seed, i & (2**64 - 1)))
        side[k] = rng.standard_normal(m.shape[1])
        if last[k] >= 0:
            near = tree.members[tree.cell[last[k]]]
            to[k] = centres[near[rng.integers(len(near))]]
    total = np.zeros_like(m)
    for way in (side, to):
        way -= (way * m).sum(axis=1)[:, None] * m
        size = np.sqrt((way * way).sum(axis=1))[:, None]
        total += np.where(size > 1e-6, way / np.maximum(size, 1e-300), 0)
    total /= np.maximum(np.sqrt((total * total).sum(axis=1)), 1e-300)[:, None]
    return threshold * m + math.sqrt(max(0.0, 1 - threshold**2)) * total


def _trees(centres: np.ndarray, passes: range, seed: int) -> list[Tree]:
    some = -(-len(centres) // DRAWN)
    return [Tree(centres, np.random.default_rng((seed, p, 1)).permutation(len(centres))[:some]) for p in passes]


def _keys(drawn, passes: range, threshold: float, seed: int):
    def run(batches):
        trees: dict[int, list[Tree]] = {}
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            ids, role = batch.column("id").to_numpy(), batch.column("role").to_numpy()
            for width, rows in _by_width(vectors).items():
                m = np.frombuffer(b"".join(vectors[i] for i in rows), np.float64).reshape(len(rows), -1)
                own, kind = ids[rows], role[rows]
                centres = drawn.value[width]
                if width not in trees:
                    trees[width] = _trees(centres, passes, seed)
                if (beside := kind == 1).any():
                    m = np.concatenate((m, plant(m[beside], own[beside], trees[width][0], centres, threshold, seed)))
                    own, kind = np.concatenate((own, own[beside])), np.concatenate((kind, np.full(beside.sum(), 2)))
                m = m.astype(np.float32)
                for p, tree in zip(passes, trees[width], strict=True):
                    leaf, signs = _place(tree, centres, m, _planes(seed, p, m.shape[1]))
                    bits = np.packbits(signs, axis=1)
                    # The width leads, so that only vectors of one length are neighbours.
                    lead = width.to_bytes(4, "big")
                    keys = [lead + x.tobytes() + y.tobytes() for x, y in zip(leaf.astype(">u4"), bits, strict=True)]
                    yield batch_of(KEYS, np.full(len(own), p), keys, own, kind)

    return run


def _ranks(batches):
    """The place of each row in its partition of the sorted keys, per pass."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        passes = batch.column("pass").to_numpy()
        at = np.empty(len(passes), np.int64)
        for p in np.unique(passes).tolist():
            rows = np.flatnonzero(passes == p)
            at[rows] = seen.get(p, 0) + np.arange(len(rows))
            seen[p] = seen.get(p, 0) + len(rows)
        yield batch_of(RANKS, batch.column("pass"), batch.column("id"), batch.column("role"), np.full(len(passes), part), at)


def _by_width(vectors: list[bytes]) -> dict[int, np.ndarray]:
    sizes = np.array([len(v) for v in vectors])
    return {int(w): np.flatnonzero(sizes == w) for w in np.unique(sizes)}


def _blocks(threshold: float):
    def run(batches):
        """Links of each half of a window with itself and the half that follows, as the least id reached from each id."""
        for table in _groups(batches):
            g, ids, half = (table.column(c).to_numpy() for c in ("g", "id", "half"))
            vectors = table.column("v").to_pylist()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(g)) + 1, [len(g)]))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for rows in _by_width(vectors[a:b]).values():
                    rows = a + rows
                    m = np.frombuffer(b"".join(vectors[i] for i in rows), np.float64).reshape(len(rows), -1)
                    h = half[rows]
                    ends = [*(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]
                    for x, y, z in zip([0, *ends], ends, [*ends[1:], len(h)], strict=False):
                        z = z if z > y and h[y] == h[x] + 1 else y
                        p, q = np.nonzero(np.triu(m[x:y] @ m[x:z].T >= threshold, 1))
                        if len(p):
                            out.append(_reach(ids[rows[x + p]], ids[rows[x + q]]))
            if out:
                yield _batch(FOUND, out)

    return run


def _reach(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per id: the smallest id that these pairs reach from it."""
    ids, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    p, q = place[: len(x)], place[len(x) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return ids, ids[label]


def _batch(schema: pa.Schema, out: list) -> pa.RecordBatch:
    return batch_of(schema, *(np.concatenate([o[k] for o in out]) for k in range(2)))


def _whole(threshold: float):
    def run(batches):
        """Links of a component's block pair: rows of role 0 with rows of role 1 (w copies each), told for the former."""
        for table in _groups(batches):
            g, ids, role, copies = (table.column(c).to_numpy() for c in ("g", "id", "role", "w"))
            vectors = table.column("v").to_pylist()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(g)) + 1, [len(g)]))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for rows in _by_width(vectors[a:b]).values():
                    rows = a + rows
                    own, other = rows[role[rows] == 0], rows[role[rows] == 1]
                    if not len(own) or not len(other):
                        continue
                    m = [np.frombuffer(b"".join(vectors[i] for i in r), np.float64).reshape(len(r), -1) for r in (own, other)]
                    near = m[0] @ m[1].T >= threshold
                    near &= ids[own][:, None] != ids[other][None, :]
                    links = near @ copies[other]
                    some = links > 0
                    out.append((ids[own][some], links[some]))
            if out:
                yield _batch(EXACT, out)

    return run


def _drawn(active: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """Centres by bytes of a vector: at most ``MOST_CENTRES`` of each length and ``MOST_CENTRE_BYTES`` go to the driver."""
    width = F.expr("octet_length(v)")
    sizes = sorted(tuple(r) for r in active.groupBy(width).agg(F.count("*")).collect())  # a row per length
    out = {}
    for size, n in sizes:
        room = max(1, MOST_CENTRE_BYTES // len(sizes) // size)
        wanted = max(1, min(MOST_CENTRES, room, DRAWN * n * LEAVES_A_BLOCK // BLOCK))
        some = active.where((width == size) & (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(-(-n // wanted))) == 0))
        raw = [bytes(r.v) for r in some.select("id", "v").sort("id").collect()]
        out[size] = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), size // 8).astype(np.float32)
    return out


def _ordered(active: DataFrame, passes: range, threshold: float, seed: int, parts: int) -> DataFrame:
    """(pass, id, role, place): the places of vectors and planted neighbours in the order of each pass."""
    spark = active.sparkSession
    drawn = spark.sparkContext.broadcast(_drawn(active, seed + passes.start))
    keys = active.select("id", "v", "role").mapInArrow(_keys(drawn, passes, threshold, seed), sql(KEYS))
    keys = keys.withColumn("tie", F.xxhash64("pass", "id", "role"))
    ordered = keys.repartitionByRange(parts, "pass", "key", "tie").sortWithinPartitions("pass", "key", "tie").drop("tie")
    places = stored(ordered.select("pass", "id", "role").mapInArrow(_ranks, sql(RANKS)))
    # One row per partition and pass goes to the driver, to number the places through.
    totals = sorted(tuple(r) for r in places.groupBy("pass", "part").agg(F.count("*")).collect())
    offsets, last, run = [], None, 0
    for p, part, n in totals:
        run = 0 if p != last else run
        offsets.append((p, part, run))
        last, run = p, run + n
    before = spark.createDataFrame(offsets, "`pass` long, part long, before long")
    return places.join(before, ["pass", "part"]).select("pass", "id", "role", (F.col("before") + F.col("at")).alias("place"))


def _half(place):
    return F.floor(place / max(1, BLOCK // 2))


def _met_in_windows(ranked: DataFrame, single: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Links between neighbours of the orders. The first half after a run of windows is sent to both runs."""
    real = ranked.where("role < 2").withColumn("half", _half(F.col("place")))
    runs = F.array_distinct(F.array(F.floor(F.col("half") / RUN), F.floor((F.greatest("half", F.lit(1)) - 1) / RUN)))
    dealt = real.withColumn("run", F.explode(runs)).withColumn("g", F.xxhash64("pass", "run"))
    dealt = dealt.select("id", "g", "half", "place").join(single.select("id", "v"), "id")
    dealt = dealt.repartition(parts, "g").sortWithinPartitions("g", "place")
    return stored(dealt.select("g", "id", "half", "v").mapInArrow(_blocks(threshold), sql(FOUND)))


def _met_whole(active: DataFrame, n: int, threshold: float, parts: int) -> DataFrame:
    """Links among all of ``n`` vectors, by pairs of blocks."""
    cuts = -(-n // max(1, BLOCK // 2))
    own = F.pmod(F.xxhash64("id"), F.lit(cuts))
    pairs = active.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))).select(
        F.xxhash64(F.least(own, "other"), F.greatest(own, "other")).alias("g"), "id", F.lit(0).cast("long").alias("half"), "v"
    )
    pairs = pairs.repartition(parts, "g").sortWithinPartitions("g")
    return stored(pairs.mapInArrow(_blocks(threshold), sql(FOUND)))


def _links(single: DataFrame, threshold: float, seed: int, parts: int) -> list[DataFrame]:
    """Stored tables of links. The driver sees a few rows a round."""
    beside = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit("planted")), F.lit(PLANTED)) == 0).cast("long")
    spark = single.sparkSession
    active = single.select("id", "v", beside.alias("role"))
    n = active.count()
    found, done, count, home, unmet = [], 0, PASSES if n > BLOCK else 1, None, None
    while n:
        ranked = _ordered(active, range(done, done + count), threshold, seed, parts)
        found.append(_met_in_windows(ranked, single, threshold, parts))
        if home is None:
            place = F.floor(F.col("place") / RANGE)
            home = stored(ranked.where("pass = 0 AND role < 2").select("id", "role", place.alias("range")))
            unmet = stored(home.where("role = 1").select("id", "range"))
        half = _half(F.col("place"))
        near = ranked.where("role > 0").groupBy("pass", "id").agg((F.max(half) - F.min(half)).alias("apart"))
        was, unmet = unmet, stored(unmet.join(near.where("apart <= 1").select("id").distinct(), "id", "left_anti"))
        for table in (ranked, was, *([active] if done else [])):
            drop_stored(spark, table)
        done += count
        planted = home.where("role = 1").groupBy("range").agg(F.count("*").alias("planted"))
        left = unmet.groupBy("range").agg(F.count("*").alias("unmet")).join(planted, "range")
        poor = stored(left.withColumn("share", F.col("unmet") / F.col("planted")).where(F.col("share") > MISSED))
        again = stored(home.join(poor.select("range"), "range").select("id", "role"))
        n, worst = again.count(), poor.agg(F.max("share")).first()[0]
        if not n:
            break
        active = stored(single.select("id", "v").join(again, "id"))
        if done * BLOCK >= n:  # the passes have cost as much as all pairs of what is left
            found.append(_met_whole(active, n, threshold, parts))
            break
        # As many passes more as bring the poorest range to the mark, and at most as many as were made.
        needed = done * math.log(MISSED) / math.log(worst) - done if worst < 1 else done
        count = max(2, min(done, math.ceil(needed)))
    return found


def near_vectors(
    df: DataFrame,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    threshold: float = 0.95,
    seed: int = 7,
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept (whether it is its component's smallest id).

    All rows are compared whatever their other columns. Links have a cosine of
    at least ``threshold`` in double precision. Vectors that are null or zero or
    hold null or non-finite numbers link with nothing, nor do rows without an
    id; vectors of different lengths are never compared. Rows that repeat an id
    are one vector, the least by its numbers. Links within a component are
    complete; what may be missed is a link that alone joins two components.
    """
    spark = df.sparkSession
    parts = parallelism(df)
    rows = df.select(order_id(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("e"))
    valid = rows.where((F.col("id") != LAST_ID) & F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull()))
    vectors = valid.mapInArrow(_vectors, sql(VECTORS))
    vectors = stored(vectors.where(F.col("v").isNotNull()).groupBy("id").agg(F.min("v").alias("v")))
    same = vectors.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    single = stored(same.select("id", "v", "w"))
    found = _links(single, threshold, seed, parts)
    links = functools.reduce(DataFrame.unionAll, found, spark.createDataFrame([], sql(FOUND)))
    labels = stored(components(links.select(F.col("id").alias("a"), F.col("least").alias("b"))))
    for table in found:
        drop_stored(spark, table)
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    large = labels.join(sizes, "component").join(single, "id")
    cuts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), cuts).cast("int")
    to = F.sequence(F.lit(0), cuts - 1)
    sides = F.concat(
        F.transform(to, lambda c: F.struct(own.alias("r"), c.alias("c"), F.lit(0).alias("role"))),
        F.transform(to, lambda r: F.struct(r.alias("r"), own.alias("c"), F.lit(1).alias("role"))),
    )
    pairs = large.withColumn("at", F.explode(sides)).select(
        F.xxhash64("component", "at.r", "at.c").alias("g"), "id", "v", "w", F.col("at.role").alias("role")
    )
    pairs = pairs.repartition(parts, "g").sortWithinPartitions("g")
    exact = pairs.mapInArrow(_whole(threshold), sql(EXACT)).groupBy("id").agg(F.sum("links").alias("links"))
    known = labels.join(exact, "id", "left").withColumnRenamed("id", "rep")
    # Each of several equal vectors follows the first of them.
    repeated = single.where("w > 1").select("v", F.col("id").alias("first"), "w")
    copies = vectors.join(repeated, "v").select("id", "first", "w")
    out = rows.select("id").join(copies, "id", "left").withColumn("rep", F.coalesce("first", "id")).join(known, "rep", "left")
    component = F.when(F.col("id") != LAST_ID, F.coalesce("component", "rep"))
    return out.select(
        F.when(F.col("id") != LAST_ID, F.col("id")).cast(df.schema[vec_id].dataType).alias(vec_id),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
