"""Merkle manifest of a dataset whose parents retain SHA-256 midstates.

A row is a leaf: the hash of its columns. Per source, leaves in the order of doc_id form a tree of fan-out FAN; the
sources' roots, in the order of source, form one more. A parent's hash reads its children from left to right, so the hash
state before each child slot is a copy of the state on the way. To fold a changed child in, the copy before its slot reads
the replacement and the siblings on its right; what lies left is never hashed again.

Leaves are numbered without a window over a source: rows are range-partitioned by (source, doc_id), counted off inside
each partition, and a table of one row a partition tells where its first source goes on. Trees are built upwards in blocks
of FAN ** LEVELS nodes, whose results are the leaves of the next round; then each block is given its way from there to the
root, and unfolds it for its own nodes. A task holds one block and that way, however many rows a source has.

Defined results: a null column is written as "-"; a null doc_id comes first in its source and is never changed by
tampering; rows that repeat a doc_id are leaves of their own, in the order of their hashes; a null source is a source,
the first; an empty table has no root and no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, quoted, written

#: Children of a parent, and levels that a task builds at once.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
#: Columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 over the fields' lengths in bytes and their values."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def folded_case(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


class Parent:
    """A node over its children's hashes. before[slot] is the hash state in front of that child."""

    __slots__ = ("before", "children", "digest")

    def __init__(self, children: list[bytes]):
        state, self.before, self.children = hashlib.sha256(), [], children
        for child in children:
            self.before.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in the slot: resumed there, reading right siblings only."""
        state = self.before[slot].copy()
        state.update(child)
        for right in self.children[slot + 1 :]:
            state.update(right)
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1 :])


def levels_over(nodes: list[bytes], levels: int) -> list[list[Parent]]:
    """Parents of each level above nodes, `levels` of them."""
    out = []
    for _ in range(levels):
        row = [Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        out.append(row)
        nodes = [p.digest for p in row]
    return out


def height(n: int) -> int:
    """Levels above n nodes, until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with pos, their number from 0 within their tree by `order`, and size, the tree's rows. Nulls come first.

    rows should be narrow: they are sampled, range-partitioned and written. A tree may span many partitions.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f.name for f in rows.schema.fields]
    key = names.index(tree)

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            numbers = []
            for value in batch.column(key).to_pylist():
                at = at + 1 if value == last else 0
                last = value
                numbers.append(at)
            yield pa.record_batch([*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())], [*names, "part", "at"])

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    dealt = rows.repartitionByRange(n, tree, *order).sortWithinPartitions(tree, *order).mapInArrow(count, schema)
    dealt = written(dealt, "numbered").withColumn("key", F.struct(tree))
    own = Window.partitionBy("key")
    before = F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = dealt.groupBy("key", "part").agg(F.count("*").alias("held")).select("key", "part", before.alias("before"), F.sum("held").over(own).alias("size"))
    # The rows of one tree and part come from one partition, so no key here has more rows than a partition.
    return dealt.join(parts, ["key", "part"]).select(*names, (F.col("before") + F.col("at")).alias("pos"), "size")


def _levels(size: int) -> int:
    return min(LEVELS, height(size))


def grown(nodes: DataFrame, tree: str) -> list[DataFrame]:
    """The rounds from nodes (tree, pos, size, digest) up: each round's nodes are the blocks of the one before.

    In the last round every tree has one node, its root.
    """

    def up(table):
        import pyarrow as pa

        table = table.sort_by("pos")
        size, pos = table.column("size")[0].as_py(), table.column("pos")[0].as_py() // BLOCK
        levels = _levels(size)
        digests = [d.encode() for d in table.column("digest").to_pylist()]
        top = levels_over(digests, levels)[-1][0].digest if levels else digests[0]
        return pa.table({"tree": table.column("tree").slice(0, 1), "pos": [pos], "size": pa.array([-(-size // FAN**levels)], pa.int64()), "digest": [top.decode()]})

    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 1) > 1:
        x = rounds[-1].select(F.col(tree).alias("tree"), "pos", "size", "digest", F.expr(f"pos div {BLOCK}").alias("block"))
        x = x.groupBy(F.struct("tree").alias("key"), "block").applyInArrow(up, "tree string, pos long, size long, digest string")
        rounds.append(written(x.withColumnRenamed("tree", tree), "nodes"))
    return rounds


class _Block:
    """Nodes of one block, their parents in it, and the way from there to the root."""

    def __init__(self, nodes, ways):
        self.nodes = nodes.sort_by("pos")
        self.way = [(x["left"], x["right"]) for x in ways.column("way")[0].as_py()]
        self.levels = levels_over([d.encode() for d in self.nodes.column("digest").to_pylist()], _levels(self.nodes.column("size")[0].as_py()))
        self.states = [hashlib.sha256(left) for left, _ in self.way]
        self.rest = b"".join(left + right for left, right in self.way)

    def places(self, i: int):
        """(parent, slot) on each level of the block, from node i up."""
        for row in self.levels:
            yield row[i // FAN], i % FAN
            i //= FAN

    def way_of(self, i: int) -> list[dict]:
        own = [{"left": b"".join(p.children[:slot]), "right": b"".join(p.children[slot + 1 :])} for p, slot in self.places(i)]
        return own + [{"left": left, "right": right} for left, right in self.way]

    def ways(self):
        import pyarrow as pa

        return pa.array([self.way_of(i) for i in range(self.nodes.num_rows)], pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())])))

    def proof(self, i: int) -> str:
        out = hashlib.sha256()
        for p, slot in self.places(i):
            out.update(p.siblings(slot))
        out.update(self.rest)
        return out.hexdigest()

    def fold(self, i: int, leaf: str) -> str:
        digest = leaf.encode()
        for p, slot in self.places(i):
            digest = p.fold(slot, digest)
        for before, (_, right) in zip(self.states, self.way, strict=True):
            state = before.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest.decode()


_WAY = "array<struct<left: binary, right: binary>>"


def _blocks(nodes: DataFrame, tree: str, others: list[str]):
    x = nodes.select(F.col(tree).alias("tree"), "pos", "size", "digest", *others, F.expr(f"pos div {BLOCK}").alias("block"))
    return x.groupBy(F.struct("tree").alias("key"), "block")


def unfolded_ways(rounds: list[DataFrame], tree: str, top: DataFrame) -> DataFrame:
    """(tree, block, way, roots) of the blocks of rounds[0], given (tree, way, roots) of the trees' own roots."""

    def down(nodes, ways):
        import pyarrow as pa

        b = _Block(nodes, ways)
        return pa.table({"tree": b.nodes.column("tree"), "block": b.nodes.column("pos"), "way": b.ways(), "roots": pa.repeat(ways.column("roots")[0], b.nodes.num_rows)})

    ways = top.select(F.col(tree).alias("tree"), F.lit(0).cast("long").alias("block"), "way", "roots")
    # The last round's nodes are roots; a root is the one block of the round below.
    for nodes in reversed(rounds[1:-1]):
        ways = _blocks(nodes, tree, []).cogroup(ways.groupBy(F.struct("tree").alias("key"), "block")).applyInArrow(down, f"tree string, block long, way {_WAY}, roots array<string>")
        ways = written(ways, "ways")
    return ways


def leaves(docs: DataFrame, tampered: Column | None = None, change=folded_case) -> DataFrame:
    """(doc_id, source, digest, changed): each row's hash, and that with `change` made to its text where tampered holds."""
    column = {c.lower(): c for c in docs.columns}
    doc_id, source, lang, n_chars, text = (quoted(column[k]).cast(kind) for k, kind in zip(FIELDS, ("long", "string", "string", "long", "string"), strict=True))
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf([doc_id, source, lang, n_chars, change(text)]))
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), leaf([doc_id, source, lang, n_chars, text]).alias("digest"), changed.alias("changed"))


def manifest(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds of nodes of the sources' trees over leaves (doc_id, source, digest, changed), and of the tree over sources."""
    bounded_batches(rows.sparkSession)
    by_source = grown(written(numbered(written(rows, "leaves"), "source", ["doc_id", "digest"]), "nodes"), "source")
    roots = by_source[-1].select(F.lit("").alias("tree"), "source", "digest")
    return by_source, grown(written(numbered(roots, "tree", ["source"]), "nodes"), "tree")


def verified(by_source: list[DataFrame], over_sources: list[DataFrame]) -> DataFrame:
    """A row for each leaf: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    proof_sha256 is the hash of all siblings on the leaf's way to the root. folded_root takes the changed leaf, or else the
    leaf, up that way; verified tells whether it is the root.
    """
    top = over_sources[-1].select("tree", F.array().cast(_WAY).alias("way"), F.array("digest").alias("roots"))
    of_blocks = unfolded_ways(over_sources, "tree", top)

    def to_sources(nodes, ways):
        import pyarrow as pa

        b, root = _Block(nodes, ways), ways.column("roots")[0].as_py()
        return pa.table({"source": b.nodes.column("source"), "way": b.ways(), "roots": [[d, *root] for d in b.nodes.column("digest").to_pylist()]})

    trees = _blocks(over_sources[0], "tree", ["source"]).cogroup(of_blocks.groupBy(F.struct("tree").alias("key"), "block"))
    trees = written(trees.applyInArrow(to_sources, f"source string, way {_WAY}, roots array<string>"), "ways")
    of_blocks = unfolded_ways(by_source, "source", trees)

    def to_leaves(nodes, ways):
        import pyarrow as pa

        b, (subroot, root) = _Block(nodes, ways), ways.column("roots")[0].as_py()
        kept, changed = b.nodes.column("digest").to_pylist(), b.nodes.column("changed").to_pylist()
        folded = [b.fold(i, c or k) for i, (k, c) in enumerate(zip(kept, changed, strict=True))]
        same = {"subroot": [subroot] * len(kept), "root": [root] * len(kept)}
        return pa.table({"doc_id": b.nodes.column("doc_id"), "source": b.nodes.column("tree"), "leaf": kept, **same, "proof_sha256": [b.proof(i) for i in range(len(kept))], "folded_root": folded, "verified": [f == root for f in folded]})

    rows = _blocks(by_source[0], "source", ["doc_id", "changed"]).cogroup(of_blocks.groupBy(F.struct("tree").alias("key"), "block"))
    return rows.applyInArrow(to_leaves, "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
