"""Hierarchical weighted hash tree: each key descends region, rack and shard by weighted hash draws.

At each level every child draws -ln(u) / weight with u hashed from the key and the child's own name; the least draw
wins. A child's draw depends on nothing but the key, its name and its weight, so a change of weights moves keys only
from or to the children whose weights changed, and only within the subtrees on their paths.

A grown cluster gets each further shard as a subtree of its own at the top, so one more shard takes rows only into
itself: no other top-level draw changes, and no tree below one does.

All in DataFrame functions. Cases: a null key is a key like any other; null text has no bytes; equal keys share a
shard, so that a key of a third of all rows (null among them) fills its shard by the law that the key decides; equal draws
go to the child named first; a child without weight gets no key, unless all have none: then the first gets them; slots are
gapless per shard, in no meaningful order; an empty table gives an empty result; extra columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import cut

#: Rows of a (shard, bucket) that one task numbers, about.
ROWS_PER_BUCKET = 500_000


@dataclass(frozen=True)
class Node:
    """A subtree: its name enters its draws; leaves carry a shard number."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def topology(n_shards: int, base: int = 8, racks: int = 2, per_rack: int = 2) -> tuple[Node, ...]:
    """Regions of racks of shards for the first `base` shards (the cluster as first built); each later shard is a region
    of its own. Fewer shards than `base` would change weights inside regions, so `base` must not exceed n_shards."""
    if n_shards < base:
        raise ValueError(f"{n_shards} shards are fewer than the base of {base}; give a smaller base")
    regions: dict[str, dict[str, list[Node]]] = {}
    for s in range(n_shards):
        region = f"region{s // (racks * per_rack)}" if s < base else f"region-of-{s}"
        rack = f"rack{s // per_rack % racks}" if s < base else "rack0"
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"shard{s}", shard=s))
    return tuple(Node(r, children=tuple(Node(f"{r}/{k}", children=tuple(leaves)) for k, leaves in by.items())) for r, by in regions.items())


def reweighted(nodes: tuple[Node, ...], weights: dict[str, float]) -> tuple[Node, ...]:
    """The same tree with other weights for the leaves named."""
    return tuple(Node(n.name, weights.get(n.name, n.weight), reweighted(n.children, weights), n.shard) for n in nodes)


def draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight; u in (0, 1] has 52 bits of the key's hash with the node's name. Without weight no draw is less."""
    if node.total <= 0:
        return F.lit(float("inf"))
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 12).cast("double") + 1.0) / float(1 << 52)
    return -F.log(u) / F.lit(float(node.total))


def descend(key: Column, nodes: tuple[Node, ...]) -> Column:
    """The shard that the key reaches; equal draws go to the node named first."""
    if len(nodes) == 1:
        only = nodes[0]
        return F.lit(only.shard) if only.shard is not None else descend(key, only.children)
    pick = F.array_min(F.array(*[F.struct(draw(key, n).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(nodes)]))["i"]
    branches = [F.lit(n.shard) if n.shard is not None else descend(key, n.children) for n in nodes]
    return F.element_at(F.array(*branches), pick + 1) if all(n.shard is not None for n in nodes) else _case(pick, branches)


def _case(pick: Column, branches: list[Column]) -> Column:
    out = F.when(pick == 0, branches[0])
    for i, b in enumerate(branches[1:], 1):
        out = out.when(pick == i, b)
    return out


def assign(docs: DataFrame, tree: tuple[Node, ...] | None = None, grown: tuple[Node, ...] | None = None, key: str = "doc_id") -> DataFrame:
    """docs with shard (by tree) and grown_shard (by grown): eight even shards, and one more, unless other trees are given."""
    return docs.withColumns({"shard": descend(F.col(key), tree or topology(8)).cast("int"), "grown_shard": descend(F.col(key), grown or topology(9)).cast("int")})


def number(rows: DataFrame, part: str = "shard") -> DataFrame:
    """Adds slot: gapless from 0 in each value of `part`, without bringing one value's rows into one task.

    Rows get a number of their own when they are cut; hashed, it deals each part over buckets of bounded size. Counts per
    (part, bucket), a few numbers for each half million rows, give every bucket's first slot.
    """
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    n = rows.count()
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(part, "_bucket").agg(F.count("*").alias("_n"))
    first = counts.select(F.col(part).alias("_part"), F.col("_bucket").alias("_b"), (F.sum("_n").over(Window.partitionBy(part).orderBy("_bucket")) - F.col("_n")).alias("_first"))
    within = F.row_number().over(Window.partitionBy(part, "_bucket").orderBy("_row")) - 1
    numbered = rows.withColumn("_within", within)
    joined = numbered.join(first, numbered[part].eqNullSafe(first["_part"]) & (numbered["_bucket"] == first["_b"]))
    return joined.withColumn("slot", (F.col("_first") + F.col("_within")).cast("long")).drop("_row", "_bucket", "_within", "_part", "_b", "_first")


def shard_documents(docs: DataFrame, tree: tuple[Node, ...] | None = None, grown: tuple[Node, ...] | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, moved. A text, however long, only gives its size and checksum."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = number(assign(rows, tree, grown))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", (F.col("shard") != F.col("grown_shard")).alias("moved"))
