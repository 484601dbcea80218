"""Sharding by a weighted hash tree of regions, racks and shards.

A key descends level by level. At a node each child draws ``-ln(u) / weight`` with ``u`` a uniform hash of the key and
the child's own name, and the smallest draw wins, so a child gets its weight's part of the keys. A draw depends on the
key, the child's name and the child's weight only: when weights change in one subtree, keys move between that subtree
and the others in the one direction the change asks for, and a subtree whose weights stay keeps its inner layout.

``grown`` adds a shard as a region of its own, so no other node's weight changes and keys move into the new shard
alone (law ``key``). Cost per row: one hash for each child on its path. All is done with built-in functions.

``sharded`` also numbers the rows of each shard from 0 without gaps: rows are numbered in ``BUCKETS`` hash buckets per
shard, and a table of ``shards x BUCKETS`` counts (its size depends on nothing else) gives each bucket its start.

Defined cases: a null id is a key like any other; rows with one id share a shard; a null text has size 1 and the CRC
of no bytes, 0; an empty table gives an empty result; columns that clash with result names are not passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


@dataclass(frozen=True)
class Node:
    """A subtree. A leaf has a shard number; an inner node weighs what its children weigh together."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def layout(shards: int, base: int = 8, racks: int = 2, per_rack: int = 2) -> Node:
    """A tree for ``shards`` equal shards: up to ``base`` fill regions of ``racks`` racks of ``per_rack`` shards; each further one is a region of its own."""
    if shards < 1:
        raise ValueError("at least one shard")
    leaf = lambda i: Node(f"shard{i}", shard=i)
    first = min(shards, base)
    rack = [Node(f"rack{k}", tuple(leaf(i) for i in range(k * per_rack, min(first, (k + 1) * per_rack)))) for k in range(-(-first // per_rack))]
    regions = [Node(f"region{k}", tuple(rack[k * racks : (k + 1) * racks])) for k in range(-(-len(rack) // racks))]
    tree = Node("root", tuple(regions))
    for _ in range(shards - first):
        tree = grown(tree)
    return tree


def leaves(tree: Node) -> list[Node]:
    return [x for c in tree.children for x in leaves(c)] if tree.children else [tree]


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a new region."""
    i = 1 + max(x.shard for x in leaves(tree))
    return Node(tree.name, (*tree.children, Node(f"region+{i}", (Node(f"rack+{i}", (Node(f"shard{i}", shard=i, own_weight=weight),)),))))


def draw(key: Column, node: Node) -> Column:
    """The child's weighted draw: exponential with the weight as its rate."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(node.weight))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that the tree gives to a key; weights of 0 never win."""
    if not tree.children:
        return F.lit(tree.shard)
    live = [c for c in tree.children if c.weight > 0]
    if len(live) == 1:
        return shard_of(key, live[0])
    best = F.array_min(F.array(*[F.struct(draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(live)]))["child"]
    chosen = F.when(best == 0, shard_of(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        chosen = chosen.when(best == i, shard_of(key, c))
    return chosen


def sharded(docs: DataFrame, tree: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` with size, text_crc32, shard, slot and grown_shard (where one more shard would put the row)."""
    made = ("size", "text_crc32", "shard", "slot", "grown_shard")
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.withColumns({
        "_size": F.octet_length(text).cast("long") + 1, "_crc": F.crc32(text.cast("binary")), "_shard": shard_of(key, tree), "_grown": shard_of(key, grown(tree)),
        "_bucket": F.pmod(F.xxhash64(key, F.crc32(text.cast("binary")), F.lit("slot")), F.lit(BUCKETS)).cast("int")})
    starts = rows.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most shards x BUCKETS rows, so it can be broadcast and one window per shard is small
    starts = starts.select("_shard", "_bucket", (F.sum("_n").over(Window.partitionBy("_shard").orderBy("_bucket")) - F.col("_n")).alias("_start"))
    within = Window.partitionBy("_shard", "_bucket").orderBy(F.col(id_col), "_crc", "_size")
    placed = rows.withColumn("_at", F.row_number().over(within)).join(F.broadcast(starts), ["_shard", "_bucket"])
    return placed.select(*[F.col(c) for c in docs.columns if c not in made], F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"),
                         (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"), F.col("_grown").alias("grown_shard"))
