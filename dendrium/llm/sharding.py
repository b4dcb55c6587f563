"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards, each shard with a weight; a node weighs what its shards weigh. A row
descends from the root: at each level every child draws ln(u) / weight, where u in (0, 1] comes from a hash of
the row's id and the child's path, and the largest draw wins (ties to the first child). A child's draw depends
on its own name and weight alone, so a changed weight moves rows only into or out of the subtrees whose weights
changed. grow() adds a shard as a region of its own: that is the one change that alters a single child of the
root and no other draw, so all rows that move go to the new shard, however often the tree has grown.

The slots of a shard are numbered without sorting a shard in one task: rows are cut by a second hash into
buckets of bounded expected size, buckets are counted, and a row's slot is its bucket's offset plus its rank in
the bucket. Rows equal in every column that is carried are counted first and dealt out again at the end, so
that one id repeated in a third of the rows makes no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrium.llm.common import table, written

#: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]


def tree(regions: int = 3, racks: int = 2, shards: int = 4) -> Tree:
    """A tree of equal weights; shards are numbered from 0."""
    return {f"r{i}": {f"k{j}": {(i * racks + j) * shards + s: 1.0 for s in range(shards)} for j in range(racks)} for i in range(regions)}


def shards_of(t: Tree) -> dict[int, float]:
    return {s: w for racks in t.values() for shards in racks.values() for s, w in shards.items()}


def grow(t: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, numbered after the last, in a region of its own."""
    new = max(shards_of(t), default=-1) + 1
    return t | {f"r{new}+": {"k0": {new: weight}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + 1) / F.lit(float(2**53))
    return F.log(u) / F.lit(float(weight))


def _first_largest(draws: list[Column]) -> Column:
    """1-based position of the largest; ties to the first."""
    return F.array_position(F.array(*draws), F.array_max(F.array(*draws))) if len(draws) > 1 else F.lit(1)


def shard_of(key: Column, t: Tree) -> Column:
    """The shard of a row with that key. Nodes of weight 0 get no rows; a null key is a key as any other."""

    def leaf(path: str, shards: dict[int, float]) -> Column:
        live = [(s, w) for s, w in shards.items() if w > 0]
        return F.element_at(F.array(*[F.lit(s) for s, _ in live]), _first_largest([_draw(key, f"{path}/{s}", w) for s, w in live]).cast("int"))

    def choose(children: list[tuple[str, float, Column]]) -> Column:
        children = [c for c in children if c[1] > 0]
        if len(children) == 1:
            return children[0][2]
        at = _first_largest([_draw(key, name, w) for name, w, _ in children])
        out = F.when(at == 1, children[0][2])
        for i, c in enumerate(children[1:], 2):
            out = out.when(at == i, c[2])
        return out

    total = lambda racks: sum(sum(s.values()) for s in racks.values())
    if not any(w > 0 for w in shards_of(t).values()):
        raise ValueError("the tree has no shard with a weight")
    return choose([(r, total(racks), choose([(f"{r}/{k}", sum(s.values()), leaf(f"{r}/{k}", s)) for k, s in racks.items() if sum(s.values()) > 0])) for r, racks in t.items() if total(racks) > 0])


def assign(docs: DataFrame, t: Tree, grown: Tree | None = None, rows_a_bucket: int = 20_000) -> DataFrame:
    """Returns doc_id, size (UTF-8 bytes and 8), text_crc32, law ('key'), shard, slot and grown_shard, a row for each
    row of docs. slot counts from 0 without gaps in each shard. grown_shard is null without a grown tree.

    A null text counts as empty. Rows with one doc_id share a shard, texts differing or not; rows equal in doc_id
    and text get different slots. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    per = rows.groupBy("doc_id", "size", "text_crc32").count()
    per = written(
        per.select("*", shard_of(F.col("doc_id"), t).alias("shard"), (shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    )
    n = per.count()
    buckets = max(16, -(-n // (rows_a_bucket * max(1, len(shards_of(t))))))
    per = per.withColumn("bucket", F.pmod(F.xxhash64(F.lit("slot"), "doc_id"), F.lit(buckets)))
    sums = per.groupBy("shard", "bucket").agg(F.sum("count").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("rank", F.coalesce(F.sum("count").over(within), F.lit(0)))
        .join(offsets, ["shard", "bucket"])
        .withColumn("first", F.col("offset") + F.col("rank"))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"), "grown_shard")
    )


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree()
    return assign(table(spark, sf_dir, "documents"), t, grow(t))
