"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

A document has two small collections of half bands. A table's key joins one half
band of each, so ``m`` and ``m`` half bands serve ``m * m`` tables and only
about the square root of the usual number of minhashes is computed.

Documents with equal sets are one. Of every key with several documents, each
document is first verified against the smallest; where a key still holds
several components, their documents are compared in blocks, by minhash estimate
and then on the sets. Links within a component add nothing and are not sought.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LAST_ID, as_bytes, batch_of, drop_stored, never_broadcast, order_id, parallelism, stored, word_hashes
from millrace.llm.components import components
from millrace.llm.token_counts import sql

SHINGLE = 4
#: Half bands in each of the two collections, and minhashes in a half band: 64 tables from 32 minhashes.
HALVES, ROWS = 8, 2
MINHASHES = 2 * HALVES * ROWS
#: Documents in a block of a key's comparison.
BLOCK = 1024
#: Pairs that share fewer minhashes are not verified: four standard deviations below the threshold of 0.8.
LEAST_SHARE = 0.5

SKETCH = pa.schema(
    [("d", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("halves", pa.list_(pa.int64())), ("sig", pa.binary())]
)
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIRS = pa.schema([("g", pa.int64()), ("x", pa.int64()), ("ys", pa.list_(pa.int64())), ("need", pa.list_(pa.int64()))])


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` lower-cased words; of the whole text if it has fewer words."""
    words = word_hashes(raw.lower().split())
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = words[:n].copy()
    for k in range(1, min(size, len(words))):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += words[k : n + k]
    if len(words) < size:
        out ^= np.uint64(len(words))  # a short text is no part of a longer one
    out ^= out >> np.uint64(32)
    return np.unique(out * np.uint64(0x94D049BB133111EB))


def sketch(found: np.ndarray, factors: np.ndarray) -> tuple[list[int], bytes]:
    """The half-band hashes and the low byte of every minhash."""
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for cut in range(0, len(found), 4096):
        least = np.minimum(least, (found[cut : cut + 4096, None] * factors[None, :]).min(axis=0))
    mixed = least ^ (least >> np.uint64(31))
    halves = np.zeros(2 * HALVES, np.uint64)
    for row in range(ROWS):
        halves = (halves ^ (halves >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[row::ROWS]
    return halves.view(np.int64).tolist(), (mixed >> np.uint64(17)).astype(np.uint8).tobytes()


def factors() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketches(batches):
    odd = factors()
    for batch in batches:
        rows = []
        for d, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            found = shingles(raw)
            digest = xxhash.xxh3_128_intdigest(found.tobytes())
            halves, sig = sketch(found, odd) if len(found) else ([], b"")
            rows.append((d, len(found), (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, halves, sig))
        yield batch_of(SKETCH, *map(list, zip(*rows))) if rows else pa.RecordBatch.from_pylist([], SKETCH)


def _groups(batches, column: str = "g"):
    """Whole groups of rows that come in order of a column, many at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 4096:
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column(column).to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(batches):
    """Pairs of documents of different components in one block of a key, whose minhashes agree enough.

    A pair that meets under several keys is told by the first of them only.
    """
    for table in _groups(batches):
        g, d, comp, i, j, role = (table.column(c).to_numpy() for c in ("g", "d", "comp", "i", "j", "role"))
        minor, least = table.column("minor").to_numpy(zero_copy_only=False), table.column("least").to_numpy()
        halves = np.array(table.column("halves").to_pylist(), np.int64).reshape(-1, 2 * HALVES)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, MINHASHES)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(g)) + 1, [len(g)]))
        out: list[list] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            start = len(out)
            left = a + np.flatnonzero(role[a:b] == 1)
            right = a + np.flatnonzero(role[a:b] == 0)
            for x in left.tolist():
                ys = right[comp[right] != comp[x]]
                # Two documents outside the key's least component meet both ways round; one is enough.
                ys = ys[~(minor[ys] & (d[ys] < d[x]))]
                if not len(ys):
                    continue
                ys = ys[(sig[ys] == sig[x]).sum(axis=1) >= LEAST_SHARE * MINHASHES]
                same = halves[ys] == halves[x]
                first = (same[:, :HALVES].argmax(axis=1) == i[x]) & (same[:, HALVES:].argmax(axis=1) == j[x])
                ys = ys[first]
                if len(ys):
                    out.append([int(g[x]), int(d[x]), d[ys].tolist(), []])
            if len(out) > start:  # the documents to verify are named once for the whole block
                out[start][3] = list({y for row in out[start:] for y in (row[1], *row[2])})
        if out:
            yield batch_of(PAIRS, *map(list, zip(*out)))


def _verify(percent: int):
    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        """Links of a group that join what is not yet joined, confirmed on the whole sets."""
        if not pairs.num_rows:
            return LINKS.empty_table()
        ids = docs.column("d").to_pylist()
        sets = [shingles(raw) for raw in as_bytes(docs.column("t"))]
        at = {d: i for i, d in enumerate(ids)}
        sizes = np.array([len(s) for s in sets], np.int64)
        universe, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        number = np.split(number, ends[:-1])
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        mark = np.zeros(len(universe), np.int8)
        links = []
        for x, listed in zip(pairs.column("x").to_pylist(), pairs.column("ys").to_pylist(), strict=True):
            i = at[x]
            ys = [at[y] for y in listed]
            ys = [y for y in ys if find(y) != find(i)]
            if not ys:
                continue
            mark[number[i]] = 1
            for part in range(0, len(ys), 512):
                chosen = ys[part : part + 512]
                each = sizes[chosen]
                both = np.add.reduceat(mark[np.concatenate([number[y] for y in chosen])].astype(np.int64), np.cumsum(each) - each)
                union = each + sizes[i] - both
                for y in np.flatnonzero(100 * both >= percent * union).tolist():
                    p, q = find(chosen[y]), find(i)
                    if p != q:
                        root[p] = q
                        links.append((ids[i], ids[chosen[y]]))
            mark[number[i]] = 0
        return pa.Table.from_batches([batch_of(LINKS, *map(list, zip(*links)))] if links else [], LINKS)

    return run


def verified_links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (group g, x, its partners ys); a group's documents (need) are sent to it once each."""
    need = pairs.select("g", F.explode("need").alias("y")).distinct()
    docs = need.join(never_broadcast(texts), need["y"] == texts["d"]).select("g", "d", "t")
    return docs.groupBy("g").cogroup(pairs.toDF(*pairs.columns).groupBy("g")).applyInArrow(_verify(percent), sql(LINKS))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept (whether it is its component's smallest id).

    Documents are linked when 100 * shared >= ``percent`` * united 4-word
    shingles of their lower-cased words; a text of fewer words is one shingle.
    Documents without words link with nothing. Null ids come last and are kept
    apart; rows that repeat an id are one node, linked by any of its texts.
    """
    spark = df.sparkSession
    parts = parallelism(df)
    rows = df.select(order_id(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sketches = stored(rows.mapInArrow(_sketches, sql(SKETCH)))
    full = sketches.where(f"n > 0 and d <> {LAST_ID}")
    reps = full.groupBy("s1", "s2").agg(F.min("d").alias("rep"))
    # One document of each set goes on.
    single = full.join(never_broadcast(reps), ["s1", "s2"]).where("d = rep").dropDuplicates(["d", "s1", "s2"]).drop("rep")
    a, b = F.slice("halves", 1, HALVES), F.slice("halves", HALVES + 1, HALVES)
    table = F.flatten(
        F.transform(
            a, lambda x, i: F.transform(b, lambda y, j: F.struct(F.xxhash64(i, j, x, y).alias("key"), i.alias("i"), j.alias("j")))
        )
    )
    single = stored(single)
    keys = single.select("d", F.explode(table).alias("k")).select("d", "k.key", "k.i", "k.j")
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("d").alias("first")).where("n > 1")
    buckets = stored(keys.join(never_broadcast(met), "key"))
    involved = buckets.select("d").distinct()
    texts = stored(rows.join(involved, "d", "left_semi"))
    # First round: each document against the smallest one of each of its keys.
    stars = buckets.where("d <> first").groupBy("d", "first").agg(F.max("n").alias("n"))
    salt = F.pmod(F.xxhash64("d"), F.ceil(F.col("n") / BLOCK))
    stars = stars.select(
        F.xxhash64("first", salt).alias("g"), F.col("d").alias("x"), F.array("first").alias("ys"), F.array("d", "first").alias("need")
    )
    links = stored(verified_links(stars, texts, percent))
    labels = components(links)
    # Second round: keys that still hold several components.
    named = buckets.join(never_broadcast(labels), buckets["d"] == labels["id"], "left").select(
        "key", "d", "i", "j", F.coalesce("component", "d").alias("comp")
    )
    named = stored(named)
    least = named.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n"))
    minors = named.join(never_broadcast(least.where("least <> most")), "key").withColumn("minor", F.col("comp") != F.col("least"))
    counts = minors.where("minor").groupBy("key").agg(F.count("*").alias("n_minor"))
    open_ = minors.join(never_broadcast(counts), "key")
    across = F.ceil(F.col("n") / BLOCK).cast("int")
    down = F.ceil(F.col("n_minor") / BLOCK).cast("int")
    own_across, own_down = F.pmod(F.xxhash64("d"), across).cast("int"), F.pmod(F.xxhash64("d"), down).cast("int")
    right = F.transform(F.sequence(F.lit(0), down - 1), lambda r: F.struct(r.alias("r"), own_across.alias("c"), F.lit(0).alias("role")))
    left = F.transform(F.sequence(F.lit(0), across - 1), lambda c: F.struct(own_down.alias("r"), c.alias("c"), F.lit(1).alias("role")))
    empty = F.array().cast("array<struct<r:int,c:int,role:int>>")
    blocks = open_.withColumn("at", F.explode(F.concat(right, F.when(F.col("minor"), left).otherwise(empty))))
    slim = single.select(F.col("d").alias("o"), "halves", "sig")
    blocks = blocks.select(
        F.xxhash64("key", "at.r", "at.c").alias("g"), "d", "comp", "i", "j", F.col("at.role").alias("role"), "minor", "least"
    )
    blocks = blocks.join(never_broadcast(slim), F.col("d") == F.col("o")).drop("o").repartition(parts, "g").sortWithinPartitions("g")
    pairs = stored(blocks.mapInArrow(_candidates, sql(PAIRS)))
    more = stored(verified_links(pairs, texts, percent))
    final = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    for done in (single, buckets, texts, links, named, pairs, more):
        drop_stored(spark, done)
    # Every document follows the representative of its set.
    member = full.select("d", "s1", "s2").join(never_broadcast(reps), ["s1", "s2"]).groupBy("d").agg(F.min("rep").alias("rep"))
    member = member.join(never_broadcast(final), member["rep"] == final["id"], "left").select(
        F.col("d").alias("m"), F.coalesce("component", "rep").alias("component")
    )
    out = sketches.join(member, sketches["d"] == member["m"], "left")
    component = F.when(F.col("d") != LAST_ID, F.coalesce("component", "d"))
    return out.select(
        F.when(F.col("d") != LAST_ID, F.col("d")).cast(df.schema[doc_id].dataType).alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("d") == component, F.lit(True)).alias("kept"),
    )
