"""Merkle manifest of a dataset: a hash tree per group, a tree over the groups, proofs and verification by folding.

A parent keeps a copy of its hash state from before each child. To fold a changed
child upwards, the state before its slot is resumed with the new digest and the
siblings to its right; what lies to its left is not hashed again.

Rows are numbered within their group and cut into blocks of 3**HEIGHT neighbours.
A round turns every block into one node, so a group of n rows takes about log3 n /
HEIGHT rounds whatever its share of all rows. Paths then go down the same rounds:
a block gets the path above it once and hands each of its nodes its own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import LAST_ID, batch_of, drop_stored, order_id, parallelism, stored
from millrace.llm.token_counts import sql

FANOUT = 3
#: Levels of the tree in a block of 3**7 = 2,187 nodes, which is hashed in one task.
HEIGHT = 7
DIGEST_BYTES = 32

NODES = pa.schema([("g", pa.string()), ("i", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
PATHS = pa.schema([("g", pa.string()), ("b", pa.int64()), ("path", pa.list_(pa.binary())), ("subroot", pa.binary())])
PROVED = pa.schema(
    [
        ("d", pa.int64()),
        ("leaf", pa.string()),
        ("subroot", pa.string()),
        ("root", pa.string()),
        ("proof_sha256", pa.string()),
        ("folded_root", pa.string()),
        ("verified", pa.bool_()),
    ]
)


class Parent:
    """Digest of some children in order, with the hash state before each of them."""

    __slots__ = ("children", "before", "digest")

    def __init__(self, children: list[bytes]) -> None:
        state = hashlib.sha256()
        self.children, self.before = children, []
        for child in children:
            self.before.append(state.copy())
            state.update(child.hex().encode())
        self.digest = state.digest()

    def replaced(self, slot: int, digest: bytes) -> bytes:
        """The digest with another child in a slot."""
        state = self.before[slot].copy()
        state.update(digest.hex().encode())
        for right in self.children[slot + 1 :]:
            state.update(right.hex().encode())
        return state.digest()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1 :]).hex().encode()


class Block:
    """The part of a tree over neighbouring nodes: up to one node where the group has more blocks, else to the top."""

    def __init__(self, digests: list[bytes], whole: bool, height: int) -> None:
        self.levels: list[list[Parent]] = []
        while len(digests) > 1 if whole else len(self.levels) < height:
            level = [Parent(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)]
            self.levels.append(level)
            digests = [p.digest for p in level]
        self.top = digests[0]

    def steps(self, i: int) -> list[tuple[Parent, int]]:
        """Parents above a node with its slot in each."""
        out = []
        for level in self.levels:
            out.append((level[i // FANOUT], i % FANOUT))
            i //= FANOUT
        return out


def _written(steps: list[tuple[Parent, int]]) -> list[bytes]:
    return [bytes([slot]) + b"".join(p.children) for p, slot in steps]


def _read(path: list[bytes]) -> list[tuple[Parent, int]]:
    return [(Parent([x[k : k + DIGEST_BYTES] for k in range(1, len(x), DIGEST_BYTES)]), x[0]) for x in path]


def _block(table: pa.Table, height: int) -> tuple[pa.Table, Block]:
    table = table.sort_by("i")
    return table, Block(table.column("digest").to_pylist(), table.column("n")[0].as_py() <= FANOUT**height, height)


def _up(height: int):
    width = FANOUT**height

    def run(table: pa.Table) -> pa.Table:
        table, block = _block(table, height)
        g, i, n = (table.column(c)[0].as_py() for c in ("g", "i", "n"))
        return pa.Table.from_batches([batch_of(NODES, [g], [i // width], [-(-n // width)], [block.top])])

    return run


def _down(height: int):
    """The path above each node of a block. Nodes with a name are the subroots of groups, where the path of a group begins."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        if not table.num_rows:
            return PATHS.empty_table()
        table, block = _block(table, height)
        over, subroot = above.column("path")[0].as_py(), above.column("subroot")[0].as_py()
        size = table.num_rows
        paths = [_written(block.steps(i)) + over for i in range(size)]
        if "name" in table.column_names:
            columns = [table.column("name").to_pylist(), [0] * size, paths, table.column("digest").to_pylist()]
        else:
            columns = [table.column("g").to_pylist(), table.column("i").to_pylist(), paths, [subroot] * size]
        return pa.Table.from_batches([batch_of(PATHS, *columns)])

    return run


def _prove(root: bytes, height: int):
    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        if not table.num_rows:
            return PROVED.empty_table()
        table, block = _block(table, height)
        over = _read(above.column("path")[0].as_py())
        rest = b"".join([p.siblings(slot) for p, slot in over])
        subroot = above.column("subroot")[0].as_py().hex()
        folds, proofs = [], []
        for i, (leaf, found) in enumerate(zip(table.column("digest").to_pylist(), table.column("found").to_pylist(), strict=True)):
            steps = block.steps(i)
            proof = hashlib.sha256(b"".join([p.siblings(slot) for p, slot in steps]))
            proof.update(rest)
            proofs.append(proof.hexdigest())
            here = leaf if found is None else found
            for p, slot in steps + over:
                here = p.replaced(slot, here)
            folds.append(here)
        size = table.num_rows
        leaves = [x.hex() for x in table.column("digest").to_pylist()]
        done = [x.hex() for x in folds]
        return pa.Table.from_batches(
            [batch_of(PROVED, table.column("d").to_pylist(), leaves, [subroot] * size, [root.hex()] * size, proofs, done, [x == root for x in folds])]
        )

    return run


def _counted(batches):
    """Rows sorted by group, with the partition and the place within group and partition."""
    part, name, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_pylist()
        places = []
        for x in g:
            if x != name:
                name, at = x, 0
            places.append(at)
            at += 1
        extra = [pa.array([part] * len(g), pa.int64()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "place"])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with the place i of each within its group ``g`` (not null) in ascending order, and the group's size n.

    Rows are sorted by range over all groups; places within a partition are moved
    on by the sizes of the partitions before it, which are a row per partition
    and group. Rows that are equal in all of ``order`` keep the order of the input.
    """
    parts = parallelism(rows)
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(parts, "g", *order, "tie").sortWithinPartitions("g", *order, "tie").drop("tie")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = stored(ordered.mapInArrow(_counted, kinds + ", part long, place long"))
    sizes = placed.groupBy("g", "part").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("g", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), F.sum("m").over(whole).alias("n"))
    found = placed.join(starts, ["g", "part"]).withColumn("i", F.col("start") + F.col("place"))
    return found.select(*rows.columns, "i", "n")


def _in_blocks(nodes: DataFrame, height: int):
    return nodes.withColumn("b", F.floor(F.col("i") / F.lit(FANOUT**height))).groupBy("g", "b")


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Tables of nodes, each the tops of the blocks of the one before; in the last every group has one. One row a round
    comes to the driver."""
    levels = [nodes]
    while True:
        blocks = _in_blocks(levels[-1].select("g", "i", "n", "digest"), height)
        levels.append(stored(blocks.applyInArrow(_up(height), sql(NODES))))
        if (levels[-1].agg(F.max("n")).first()[0] or 1) <= 1:
            return levels


def _beside(nodes: DataFrame, above: DataFrame, fn, made: pa.Schema, height: int) -> DataFrame:
    """``fn`` on each block and the path above it."""
    paths = above.toDF(*above.columns).groupBy("g", "b")
    return _in_blocks(nodes, height).cogroup(paths).applyInArrow(fn, sql(made))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 over the columns in order: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value as text."""
    fields = []
    for value in columns.values():
        text = value.cast("string")
        fields.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*fields), 256))


def merkle_manifest(
    df: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "source",
    doc_id: str = "doc_id",
    found: dict[str, Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A row's leaf hashes ``columns``. Within a group leaves ascend by ``doc_id``
    (null last) and every three neighbours become a node until one, the subroot,
    is left; subroots by group (null first, then bytewise) likewise give the root.
    ``proof_sha256`` hashes the siblings of the way up, left to right, level by
    level. ``found`` gives columns as they are found now: the leaf of those values
    is folded up among the siblings of the manifest, and ``verified`` says whether
    the manifest's root comes out. A row whose ``found`` is null everywhere is as
    it was. Equal ids are ordered by leaf, and equal rows are leaves of their own;
    empty texts have no bytes but are not null. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    here = {c: F.col(c) for c in columns}
    leaf = leaf_digest(here)
    found = found or {}
    now = leaf_digest({c: F.coalesce(found[c], here[c]) if c in found else here[c] for c in columns})
    touched = F.lit(False)
    for value in found.values():
        touched = touched | value.isNotNull()
    name = F.col(group).cast("string")
    leaves = stored(
        df.select(
            F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("g"),
            order_id(doc_id).alias("d"),
            leaf.alias("digest"),
            F.when(touched, now).alias("found"),
        )
    )
    levels = _rounds(stored(numbered(leaves, "d", "digest")), height)
    drop_stored(df.sparkSession, leaves)
    groups = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    over = _rounds(stored(numbered(groups, "name")), height)
    root = over[-1].first()
    root = bytes(root["digest"]) if root else b""
    above = df.sparkSession.createDataFrame([("", 0, [], None)], "g string, b long, path array<binary>, subroot binary")
    for nodes in reversed(over[:-1]):
        above = _beside(nodes, above, _down(height), PATHS, height)
    for nodes in reversed(levels[1:-1]):
        above = _beside(nodes, above, _down(height), PATHS, height)
    proved = _beside(levels[0], above, _prove(root, height), PROVED, height)
    own = F.when(F.col("d") != LAST_ID, F.col("d")).cast(df.schema[doc_id].dataType).alias(doc_id)
    return proved.select(own, *PROVED.names[1:])
