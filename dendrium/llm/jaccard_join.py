"""N-gram Jaccard join with adaptive multi-match prefixes, down to the classes of linked documents.

1. Every text becomes its set of shingle hashes. Documents with equal sets are one node (64 bits of two sums over the
   set); a histogram of hash buckets over all sets, of fixed size, estimates how frequent a shingle is.
2. A node's shingles are ordered by that estimate, rarest first. Two sets of sizes n and m that are similar enough
   share at least `need` shingles, so the first n - ceil(t n) + k and m - ceil(t m) + k of them share k. Each node
   chooses its own k: a longer prefix costs more postings, but a candidate must share more of it before it is
   verified; k is where the estimated cost of postings and verifications is least.
3. Groups of near copies are not expanded into pairs. Of the nodes in whose prefixes a shingle lies, the one with most
   shared shingles stands for it; each node is compared with the one that stands for most of its shingles. Who links is
   contracted, and who is merely near (NEAR) becomes a member of that node's star. These nodes then meet those that
   stand for their shingles in other components, once, and what links is contracted as well.
4. Stars whose middles are near become one, if all members of the smaller are near the other's middle: a lone node beside
   a large group then meets its members by differences, and not on the shingles that all of them have.
   Within a star, members are compared by their differences from its middle R: a member lacks a of R's shingles and has
   b others. X and Y link if their differences share at least (a + b + a' + b' - h (n + m)) / 2, h = (1 - t) / (1 + t).
   Members that link with R are one component. For another member Y, let X and Y share none of the shingles that R
   lacks; then 2 min(a, a') >= a + b + a' + b' - h (n + m) > a (1 + h) + b (1 - h), hence a > b. So pairs meet on shingles
   that R lacks, which are few and rare, and only members with a > b meet on shingles that they lack as well. Of the former
   only so many are looked at, those of fewest members first, that linked ones must share one of them.
5. Nodes of different stars meet on prefix shingles: first the rings of stars (members about as far from their middle),
   members only of rings whose middles are near enough (by the triangle inequality of set differences). The postings of a shingle with many stars are dealt out by
   classes of set sizes first. A pair is verified if it shares as many prefix shingles as similar sets must: with c
   shared, the sets share at most c + ceil(t n) - k in all, n and k of the node whose prefix ends first.
6. Verified links are closed into components.

No cap anywhere: the histogram only sets an order, which is right whatever it is, and bitmaps only drop what
cannot match. Shingles and nodes are compared as 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dendrium.llm.common import lean, release, table, written
from dendrium.llm.components import components
from dendrium.llm.packing import slices
from dendrium.llm.reduce import added, bitmap, parts_of
from dendrium.llm.shingles import mix, shingle_sets

BUCKETS = 1 << 20
LONGEST = 8
#: Cost of a verification in postings, for choosing k.
VERIFY_COST = 30.0
SLICE_BYTES = 1_000_000
#: Stars beyond which a shingle's postings are dealt out by size, classes that lie between sizes that may just link, and the
#: ratio of sizes in a group of such postings.
CROWDED, CLASSES, RATIO = 32, 2, 1.03
#: Similarity with its middle, in percent, that makes a node a member of a star, and comparisons with one set in a task.
NEAR, FAN = 50, 400
#: Rows of a table of hot nodes that are broadcast.
MANY = 100_000


@dataclass(frozen=True)
class Rule:
    """Sets link when 100 * shared >= percent * union; shingles have so many words."""

    words: int
    percent: int

    @property
    def slack(self) -> float:
        """Sets of n and m shingles link if they differ in slack * (n + m) at most."""
        return (100 - self.percent) / (100 + self.percent)

    def least(self, n):
        """ceil(t * n): what a set of n shares at least with a similar one."""
        return -((-self.percent * n) // 100)

    def need(self, n: Column, m: Column) -> Column:
        """ceil(t / (1 + t) * (n + m))."""
        return F.ceil((n + m) * self.percent / F.lit(100 + self.percent) - 1e-9)


def node_of(s: np.ndarray) -> int:
    """64 bits of a set: two different sums over its members, mixed."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64)
        return int(mix(np.array([a ^ mix(np.array([b + np.uint64(len(s))], np.uint64))[0]], np.uint64)).view(np.int64)[0])


def prefix(s: np.ndarray, estimate: np.ndarray, usual: float, rule: Rule) -> tuple[np.ndarray, int]:
    """The first shingles of a set in order, and its k."""
    n = len(s)
    order = np.lexsort((s, estimate))
    least = rule.least(n)
    longest = min(LONGEST, least)
    p = n - least + np.arange(1, longest + 1)
    lists = np.maximum(0.0, estimate[order[: p[-1]]] - usual - 3 * usual**0.5 - 1)
    met = np.cumsum(lists)[p - 1]
    k = int(np.argmin(p + met + VERIFY_COST * met / np.arange(1, longest + 1))) + 1
    return s[order[: p[k - 1]]], k


def _facts(docs: DataFrame, rule: Rule) -> DataFrame:
    """A row (doc_id, key, n, node) for each document, and rows (part, counts) of the tasks' histograms."""
    names = ["doc_id", "key", "n", "node", "part", "counts"]

    def run(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(piece.column("text"), rule.words)
                for s in sets:
                    np.add.at(total, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                n = pa.array([len(s) for s in sets], pa.int64())
                node = pa.array([node_of(s) for s in sets], pa.int64())
                none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), n, node, *none], names=names)
        parts = parts_of(total)
        if k := parts.num_rows:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 4, *parts.columns], names=names)

    return written(docs.mapInArrow(lean(run), "doc_id long, key long, n long, node long, part int, counts binary"))


def _prefixes(docs: DataFrame, rule: Rule, histogram: np.ndarray) -> DataFrame:
    """A row (node, n, k, tokens) for each document with shingles."""
    shipped = docs.sparkSession.sparkContext.broadcast(histogram.astype(np.float32))
    usual = float(histogram.sum() / BUCKETS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                rows = [(s, *prefix(s, shipped.value[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], usual, rule)) for s in shingle_sets(piece.column("text"), rule.words) if len(s)]
                tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(t) for _, t, _ in rows)]), pa.int32()), pa.array(np.concatenate([t for _, t, _ in rows]).view(np.int64) if rows else [], pa.int64()))
                columns = [pa.array([node_of(s) for s, _, _ in rows], pa.int64()), pa.array([len(s) for s, _, _ in rows], pa.int32()), pa.array([k for _, _, k in rows], pa.int32()), tokens]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "k", "tokens"])

    return written(docs.select("text").mapInArrow(lean(run), "node long, n int, k int, tokens array<long>"))


def _postings(prefixes: DataFrame) -> DataFrame:
    """A row (token, node, n, k, cnt) for each prefix shingle that several nodes have; cnt counts a node's."""
    tokens = prefixes.select(F.explode("tokens").alias("token"), "node")
    shared = written(tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("token"))
    shipped = prefixes.sparkSession.sparkContext.broadcast(bitmap(shared, F.col("token"), shared.count()))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            tokens = batch.column("tokens")
            flat = np.asarray(tokens.flatten(), np.int64)
            ok = np.flatnonzero(shipped.value.has(flat.view(np.uint64)))
            row = pa.array(np.asarray(pc.list_parent_indices(tokens))[ok])
            yield pa.RecordBatch.from_arrays([pa.array(flat[ok]), *(batch.column(c).take(row) for c in ("node", "n", "k"))], names=["token", "node", "n", "k"])

    plain = written(prefixes.mapInArrow(lean(run), "token long, node long, n int, k int").join(shared, "token").distinct())
    out = written(plain.join(plain.groupBy("node").agg(F.count("*").alias("cnt")), "node").select("token", "node", "n", "k", "cnt"))
    release(plain), release(shared)
    return out


def _sets(docs: DataFrame, rule: Rule, wanted: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A row (node, tokens) for each wanted node, and perhaps for some more; tokens is its whole set. With pairs (a, b), one b
    for an a, also b for the node as a."""
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, F.col("node"), wanted.count()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                rows = {node_of(s): s for s in shingle_sets(piece.column("text"), rule.words) if len(s)}
                nodes = np.fromiter(rows, np.int64, len(rows))
                nodes = nodes[shipped.value.has(nodes.view(np.uint64))]
                chosen = [rows[x] for x in nodes.tolist()]
                tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, chosen)]), pa.int32()), pa.array(np.concatenate(chosen).view(np.int64) if chosen else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), tokens], names=["node", "tokens"])

    rows = docs.select("text").mapInArrow(lean(run), "node long, tokens array<long>")
    rows = rows.groupBy("node").agg(F.first("tokens").alias("tokens"))
    return written(rows if pairs is None else rows.join(pairs.select(F.col("a").alias("node"), "b"), "node", "left"))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets that a bitmap of the nodes lets through, so that only few others are shuffled."""
    shipped = sets.sparkSession.sparkContext.broadcast(bitmap(nodes, F.col("node"), nodes.count()))

    def run(batches):
        for batch in batches:
            found = shipped.value.has(batch.column("node").to_numpy().view(np.uint64))
            yield batch.take(np.flatnonzero(found))

    return sets.select("node", "tokens").mapInArrow(lean(run), "node long, tokens array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, with_a: DataFrame | None = None) -> DataFrame:
    """Adds a_set and b_set to written pairs (a, b). A node that many are compared with (as b) has its set copied, once for each
    FAN of them, so that it is no hot key. with_a: the pairs with a_set, if they are at hand."""
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).cast("int").alias("copies"))
    many = copies.where("copies > 1")
    many = F.broadcast(many) if many.count() < MANY else many
    if with_a is None:
        left = _only(sets, pairs.select(F.col("a").alias("node")).distinct()).select(F.col("node").alias("a"), F.col("tokens").alias("a_set"))
        with_a = pairs.join(left, "a")
    right = _only(sets, copies.select(F.col("b").alias("node"))).withColumnRenamed("node", "b").join(many, "b", "left").select("b", F.col("tokens").alias("b_set"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    dealt = with_a.join(many, "b", "left").withColumn("copy", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    return dealt.join(right, ["b", "copy"]).drop("copy")


def _with_shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds shared, the size of the intersection, and both, that of the sets together, to written pairs (a, b)."""
    out = _compared(pairs, sets).withColumns({"shared": F.size(F.array_intersect("a_set", "b_set")), "both": F.size("a_set") + F.size("b_set")})
    return out.drop("a_set", "b_set")


def _near(pairs: DataFrame, sets: DataFrame, with_a: DataFrame | None = None) -> DataFrame:
    """The written pairs (a, b) that are similar by NEAR percent, with the sizes n and size, and the arrays lacks (of b's
    shingles) and has (others than b's) of a, written."""
    counted = _compared(pairs, sets, with_a).withColumn("has", F.array_except("a_set", "b_set")).withColumns({"n": F.size("a_set"), "size": F.size("b_set")})
    near = counted.where(100 * (F.col("n") - F.size("has")) >= NEAR * (F.col("size") + F.size("has")))
    return written(near.select("a", "b", "n", "size", F.array_except("b_set", "a_set").alias("lacks"), "has"))


def _link(rule: Rule) -> Column:
    return 100 * F.col("shared") >= rule.percent * (F.col("both") - F.col("shared"))


def _links(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link, written."""
    pairs = written(pairs.select("a", "b"))
    out = written(_with_shared(pairs, sets).where(_link(rule)).select("a", "b"))
    release(pairs)
    return out


def _sizes_fit(rule: Rule) -> Column:
    return (100 * F.col("n") >= rule.percent * F.col("m")) & (100 * F.col("m") >= rule.percent * F.col("n"))


def _must(rule: Rule, n: Column, m: Column, k: Column, l: Column) -> Column:
    """How many prefix shingles linked nodes of sizes n and m share at least."""
    ceil = lambda x: F.ceil(x * rule.percent / F.lit(100) - 1e-9)
    return F.greatest(F.least(k, l), rule.need(n, m) - F.greatest(ceil(n) - k, ceil(m) - l))


def _must_of_groups(rule: Rule) -> Column:
    """The same at least for any two members of groups with sizes n to most and n2 to most2, and k and k2 at least."""
    ceil = lambda x: F.ceil(x * rule.percent / F.lit(100) - 1e-9)
    one = rule.need(F.col("most"), F.col("n2")) - ceil(F.col("most")) + F.col("k")
    two = rule.need(F.col("n"), F.col("most2")) - ceil(F.col("most2")) + F.col("k2")
    return F.greatest(F.least("k", "k2"), F.least(one, two) - F.when((F.col("n") == F.col("most")) & (F.col("n2") == F.col("most2")), 0).otherwise(1))  # 1 for what ceil() adds


def _may_link(rule: Rule) -> Column:
    """For a pair with n, k, cnt and m, l, cnt2: whether both have as many shared shingles as they must share."""
    must = _must(rule, F.col("n"), F.col("m"), F.col("k"), F.col("l"))
    return _sizes_fit(rule) & (F.least("cnt", "cnt2") >= must)


def _likely(rule: Rule) -> Column:
    """For a pair with n, k and m, l that met on c shingles: whether that is not just one, where linked nodes share more than two. Of what
    meets by chance no set is fetched; whoever is left out here is a star of its own and meets all others later."""
    return (F.col("c") > 1) | (_must(rule, F.col("n"), F.col("m"), F.col("k"), F.col("l")) <= 2)


def _first_pairs(postings: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): each node and the one that stands for most of its shingles. A shingle's node is the one with most shared
    shingles (cnt, then node), as those in the middle of a group have; so b is above a in that order."""
    low = postings.groupBy("token").agg(F.max(F.struct("cnt", "node", "n", "k")).alias("low"))
    met = postings.join(low, "token").where(F.col("node") != F.col("low.node")).select(
        F.col("node").alias("a"), "n", "k", "cnt", F.col("low.node").alias("b"), F.col("low.n").alias("m"), F.col("low.k").alias("l"), F.col("low.cnt").alias("cnt2")
    )
    counted = met.where(_may_link(rule)).groupBy("a", "b").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("cnt2", "n", "m", "k", "l")])
    return counted.where(_likely(rule)).groupBy("a").agg(F.max(F.struct("c", "cnt2", "b")).alias("best")).select("a", "best.b")


def _stars(near: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """For near pairs, in which b is above a and every a has one b: members (node, star, n, lacks, has, border) with their
    differences from the middle of their star, written. Nodes that are near nobody above them are middles, and not members."""
    at = written(near.select(F.col("a").alias("node"), F.col("b").alias("star")))
    while True:  # b is above a, so paths end; each round halves them
        over = at.select(F.col("node").alias("star"), F.col("star").alias("over"))
        moved = Observation()
        new = at.join(over, "star", "left").observe(moved, F.max(F.col("over").isNotNull()).alias("any"))
        new = written(new.select("node", F.coalesce("over", "star").alias("star")))
        release(at)
        at = new
        if not moved.get["any"]:
            break
    ends = at.select(F.col("node").alias("a"), "star")
    same = near.join(ends, "a").where(F.col("b") == F.col("star")).drop("star")
    other = written(near.select("a", "b").join(ends, "a").where(F.col("b") != F.col("star")).select("a", F.col("star").alias("b")))
    far = _near(other, sets)
    border = 100 * (F.col("n") - F.size("has")) < rule.percent * (F.col("size") + F.size("has"))
    out = written(same.unionByName(far).select(F.col("a").alias("node"), F.col("b").alias("star"), "n", "lacks", "has", border.alias("border")))
    release(at), release(other), release(far)
    return out


def _merged_stars(reach: DataFrame, members: DataFrame, sets: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members after whole stars have gone over to near ones with more members; those that went; and (old, home), the stars
    that went and where to. All written.

    reach has pairs of stars; of those with near middles, a middle takes the one with most members above its own (members,
    then middle) and follows that to the end, as in _stars. A star with a member that is not near its new middle stays.
    """
    pairs = reach.where("near").select(F.col("star").alias("s"), F.col("star2").alias("t"))
    edges = pairs.union(pairs.select("t", "s")).distinct()
    held = members.groupBy("star").agg(F.count("*").alias("members"))
    for x in ("s", "t"):
        edges = edges.join(held.withColumnsRenamed({"star": x, "members": f"{x}_members"}), x, "left").withColumn(f"{x}_members", F.coalesce(f"{x}_members", F.lit(0)))
    above = edges.where(F.struct(F.col("t_members").alias("m"), F.col("t").alias("x")) > F.struct(F.col("s_members").alias("m"), F.col("s").alias("x")))
    best = written(above.groupBy(F.col("s").alias("a")).agg(F.max(F.struct("t_members", "t")).alias("best")).select("a", F.col("best.t").alias("b")))
    near = _near(best, sets)
    middles = _stars(near, sets, rule)
    going = written(members.select(F.col("node").alias("a"), F.col("star").alias("old")).join(middles.select(F.col("node").alias("old"), F.col("star").alias("b")), "old"))
    to = written(going.select("a", "b"))
    found = _near(to, sets)
    split = going.join(found.select("a"), "a", "left_anti").select("old").distinct()
    homes = written(middles.select(F.col("node").alias("old"), F.col("star").alias("home")).join(split, "old", "left_anti"))
    border = 100 * (F.col("n") - F.size("has")) < rule.percent * (F.col("size") + F.size("has"))
    others = found.join(going.select("a", "old"), "a").join(homes, "old", "left_semi")
    went = middles.join(homes.select(F.col("old").alias("node")), "node", "left_semi")
    went = written(went.unionByName(others.select(F.col("a").alias("node"), F.col("b").alias("star"), "n", "lacks", "has", border.alias("border"))))
    out = written(members.join(went.select("node"), "node", "left_anti").unionByName(went))
    for t in (best, near, middles, going, to, found):
        release(t)
    return out, went, homes


def _linked(near: DataFrame, members: DataFrame) -> DataFrame:
    return near.select("a", "b").union(members.where(~F.col("border")).select(F.col("node").alias("a"), F.col("star").alias("b"))).distinct()


def _differ(x: str = "") -> tuple[Column, Column, Column]:
    return F.col(f"a{x}"), F.col(f"b{x}"), F.col(f"n{x}")


def _may_link_in_star(rule: Rule, shared_has: Column | None = None) -> Column:
    """For members with a, b, n and a2, b2, n2: whether they can share enough of their differences."""
    (a, b, n), (a2, b2, n2) = _differ(), _differ("2")
    most = F.least(a, a2) + (F.least(b, b2) if shared_has is None else shared_has)
    return 2 * most >= a + b + a2 + b2 - rule.slack * (n + n2) - 1e-6


def _first_of_has(rows: DataFrame, rule: Rule) -> DataFrame:
    """For rows (star, token, node, comp, border, n, a, b) of the shingles that members have and their middle has not, with f, how
    many members have it, and low, the least n of those: the rows that members have to meet on, and rest, how many of a member's are left out.

    Sets of n and m that link have n - t / (1 + t) (n + m) shingles at most that are not in the other. With m the least size of a partner,
    as many of a member's b as that may differ; all others are shared. Rarest first, that many and one more are enough, so what
    many members have in common is not what they meet on."""
    t = rule.percent / 100
    per = rows.groupBy("star", "node", "comp", "border", "n", "a", "b").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("all"), F.min("low").alias("low"))
    differ = F.floor(F.col("n") - t / (1 + t) * (F.col("n") + F.greatest("low", F.col("n") * t)) + 1e-6)
    per = per.withColumn("rest", F.greatest(F.lit(0), F.col("b") - differ - 1).cast("int")).where(F.size("all") > F.col("rest"))
    return per.withColumn("token", F.explode(F.slice("all", F.lit(1), F.size("all") - F.col("rest")))).withColumn("token", F.col("token.token")).drop("all", "low")


def _star_pairs(members: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of members of one star that may link and are in different components."""
    sized = members.select("node", "star", "n", "border", F.size("lacks").alias("a"), F.size("has").alias("b"), "lacks", "has")
    known = written(sized.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    narrow = ["star", "token", "node", "comp", "border", "n", "a", "b"]
    has = known.select(F.explode("has").alias("token"), *[c for c in narrow if c != "token"])
    mixed = has.groupBy("star", "token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("border").alias("edge"), F.count("*").alias("f"), F.min("n").alias("low")).where("lo != hi and edge").select("star", "token", "f", "low")
    has = written(_first_of_has(has.join(mixed, ["star", "token"]), rule))
    renamed = {c: f"{c}2" for c in [*narrow, "rest"] if c not in ("star", "token")}
    other = F.col("comp") != F.col("comp2")
    one = has.join(has.withColumnsRenamed(renamed), ["star", "token"]).where(other & (F.col("node") < F.col("node2")) & (F.col("border") | F.col("border2")) & _may_link_in_star(rule))
    one = one.groupBy("node", "node2").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("a", "b", "n", "rest", "a2", "b2", "n2", "rest2")])
    pairs = one.where(_may_link_in_star(rule, F.col("c") + F.greatest("rest", "rest2"))).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    h = rule.slack
    least = F.floor((F.col("a") * (1 + h) + F.col("b") * (1 - h)) / 2 - 1e-6) + 1
    lossy = known.where("a > b").select(F.explode(F.slice("lacks", F.lit(1), (F.col("a") - least + 1).cast("int"))).alias("token"), *[c for c in narrow if c != "token"])
    border = known.where("border").select(F.explode("lacks").alias("token"), *[c for c in narrow if c != "token"]).withColumnsRenamed(renamed)
    fits = other & (~F.col("border") | (F.col("a2") > F.col("b2"))) & _may_link_in_star(rule)
    two = lossy.join(border, ["star", "token"]).where(fits).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    out = written(pairs.union(two).distinct())
    release(has), release(known)
    return out


def _second_pairs(postings: DataFrame, rule: Rule, labels: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): each node and the one that most of its shingles meet among one node for each shingle, of other components.
    Members of one star whose differences are too many do not meet."""
    sized = members.select("node", "star", F.size("lacks").alias("a"), F.size("has").alias("b"))
    known = postings.join(labels, "node", "left").join(sized, "node", "left").withColumns({"comp": F.coalesce("comp", "node"), "star": F.coalesce("star", "node"), "a": F.coalesce("a", F.lit(0)), "b": F.coalesce("b", F.lit(0))})
    all_of = ["node", "n", "k", "cnt", "comp", "star", "a", "b"]
    by = F.xxhash64("node").alias("o")
    low = known.groupBy("token").agg(F.max(F.struct(by, *all_of)).alias("hi"), F.min(F.struct(by, *all_of)).alias("lo"))
    one = F.when(F.col("comp") != F.col("hi.comp"), F.col("hi")).when(F.col("comp") != F.col("lo.comp"), F.col("lo"))
    met = known.join(low, "token").withColumn("x", one).where("x is not null").drop("hi", "lo")
    met = met.withColumns({"m": F.col("x.n"), "l": F.col("x.k"), "cnt2": F.col("x.cnt"), "n2": F.col("x.n"), "a2": F.col("x.a"), "b2": F.col("x.b")})
    met = met.where(_may_link(rule) & ((F.col("star") != F.col("x.star")) | _may_link_in_star(rule)))
    counted = met.groupBy("node", F.col("x.node").alias("y")).agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n", "m", "k", "l")])
    return counted.where(_likely(rule)).groupBy("node").agg(F.max(F.struct("c", "y")).alias("best")).select(F.col("node").alias("a"), F.col("best.y").alias("b"))


def _by_class(rows: DataFrame, rule: Rule) -> DataFrame:
    """Deals the postings of a crowded shingle out by classes of sizes: one row for each class that a partner may have, but
    not if the node has fewer shared shingles than any partner of that class asks for. A pair meets in one (lo, hi). A posting is
    in 2 * CLASSES + 1 rows at most, whatever the sizes of groups."""
    t, least = rule.percent / 100, float(np.log(RATIO))
    step = max(least, float(-np.log(t)) / CLASSES * (1 + 1e-6))  # no whole number of steps, so that rounding does not matter
    own, fine = (F.floor(F.log(F.col("n")) / x).cast("int") for x in (step, least))
    reach = int(np.ceil(-np.log(t) / step))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")

    def least_must(j: Column) -> Column:
        small, large = F.greatest(n * t, F.exp(j * step) * 0.999), F.least(n / t, F.exp((j + 1) * step) * 1.001)
        first, second = t / (1 + t) * (n + small) - t * n + k, t / (1 + t) * (n + large) - t * large + 1
        return F.when(small > large + 1e-6, F.lit(1e18)).otherwise(F.least(first, second) - 1)  # 1 for what ceil() adds

    fits = F.filter(F.sequence(own - reach, own + reach), lambda j: F.col("cnt") >= least_must(j))
    return rows.withColumns({"own": own, "fine": fine}).withColumn("j", F.explode(fits)).withColumns({"lo": F.least("own", "j"), "hi": F.greatest("own", "j")}).drop("j")


def _other_links(docs: DataFrame, postings: DataFrame, labels: DataFrame, members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The links (a, b) of nodes in different components. Stars with near middles are one star first; members of one star
    meet by their differences, and nodes of different stars if they share as many prefix shingles as linked ones must;
    both are verified. sets has the sets of all members and middles; what else is needed is made here."""
    sized = members.select("node", "star", (F.size("lacks") + F.size("has")).alias("d"))
    known = postings.drop("cnt").join(labels, "node", "left").join(sized, "node", "left")
    known = written(known.select("token", "node", "n", "k", F.coalesce("comp", "node").alias("comp"), F.coalesce("star", "node").alias("star"), F.coalesce("d", F.lit(0)).alias("d")))
    mixed = known.groupBy("token", "star").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).groupBy("token").agg(F.count("*").alias("stars"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known, old = written(known.join(mixed.where("stars > 1 and lo != hi").select("token", "stars"), "token")), known
    release(old)
    known, old = written(known.join(known.groupBy("node").agg(F.count("*").alias("cnt")), "node")), known
    release(old)
    crowded = F.col("stars") > CROWDED
    plain = known.where(~crowded).withColumns({"own": F.lit(-1), "fine": F.lit(-1), "lo": F.lit(-1), "hi": F.lit(-1)})
    known, old = written(plain.unionByName(_by_class(known.where(crowded), rule)).drop("stars").withColumn("ring", F.floor(2 * F.sqrt("d")).cast("int"))), known
    release(old)
    key, part = ["token", "lo", "hi"], ["own", "fine", "star", "ring"]
    groups = written(known.groupBy(*key, *part).agg(
        F.max("cnt").alias("cnt"), F.min("n").alias("n"), F.max("n").alias("most"), F.min("k").alias("k"), F.max("d").alias("d"),
        F.count("*").alias("members"), F.min("comp").alias("comp"), F.max("comp").alias("last"),
    ))
    names = {c: f"{c}2" for c in groups.columns if c not in key}
    near = (100 * F.col("most2") >= rule.percent * F.col("n")) & (100 * F.col("most") >= rule.percent * F.col("n2"))
    apart = (F.col("comp") != F.col("comp2")) | (F.col("comp") != F.col("last")) | (F.col("comp2") != F.col("last2"))
    meets = (F.col("star") < F.col("star2")) & ((F.col("lo") == F.col("hi")) | (F.col("own") != F.col("own2")))
    met = written(groups.join(groups.withColumnsRenamed(names), key).where(meets & near & apart & (F.least("cnt", "cnt2") >= _must_of_groups(rule))))
    stars = written(met.groupBy(F.col("star").alias("a"), F.col("star2").alias("b")).agg(
        F.max(F.col("d") + F.col("d2")).alias("ds"), F.max(F.greatest("members", "members2")).alias("members"), F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n", "n2", "k", "k2")],
        F.max(F.col("most") + F.col("most2")).alias("sizes"),
    ))
    lone = (F.col("ds") == 0) & (F.col("members") == 1)  # only middles have no differences
    direct = written(stars.where(lone & (F.col("c") >= _must(rule, F.col("n"), F.col("n2"), F.col("k"), F.col("k2")))).select("a", "b"))
    wide = written(stars.where(~lone).select("a", "b", "ds", "sizes"))
    wanted = written(_nodes(direct.union(wide.select("a", "b"))).join(sets.select("node"), "node", "left_anti"))
    more = _sets(docs, rule, wanted)
    sets = sets.select("node", "tokens").union(more.join(wanted, "node", "left_semi"))
    within = F.col("apart") - F.col("ds") <= rule.slack * F.col("sizes") + 1e-6
    reach = _with_shared(wide, sets).withColumn("apart", F.col("both") - 2 * F.col("shared")).where(within)
    alike = (100 * F.col("shared") >= NEAR * (F.col("both") - F.col("shared"))).alias("near")
    reach = written(reach.select(F.col("a").alias("star"), F.col("b").alias("star2"), "apart", alike))
    together, went, homes = _merged_stars(reach, members, sets, rule)
    inside = _links(_star_pairs(together, labels, rule), sets, rule).union(went.where("not border").select(F.col("node").alias("a"), F.col("star").alias("b")))
    home, home2 = homes.withColumnRenamed("old", "star"), homes.withColumnsRenamed({"old": "star2", "home": "home2"})
    apart = reach.drop("near").join(home, "star", "left").join(home2, "star2", "left").where(F.coalesce("home", "star") != F.coalesce("home2", "star2")).drop("home", "home2")
    rings = F.col("apart") - F.col("d") - F.col("d2") <= rule.slack * (F.col("most") + F.col("most2")) + 1e-6
    part2 = [f"{c}2" for c in part]
    chosen = written(met.join(apart, ["star", "star2"]).where(rings).select(*key, *part, *part2, "apart"))
    fields = ["node", "n", "k", "cnt", "comp", "d"]
    left, right = known.select(*key, *part, *fields), known.select(*key, *part, *fields).withColumnsRenamed({c: f"{c}2" for c in part + fields})
    close = F.col("apart") - F.col("d") - F.col("d2") <= rule.slack * (F.col("n") + F.col("n2")) + 1e-6
    must = _must(rule, F.col("n"), F.col("n2"), F.col("k"), F.col("k2"))
    pairs = chosen.join(left, [*key, *part]).join(right, [*key, *part2]).where((F.col("comp") != F.col("comp2")) & close & (F.least("cnt", "cnt2") >= must))
    counted = pairs.groupBy("node", "node2").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n", "n2", "k", "k2")])
    out = _links(direct.union(counted.where(F.col("c") >= must).select("node", "node2")), sets, rule)
    inside = written(inside)
    for t in (known, groups, met, stars, direct, wide, wanted, more, reach, chosen, together, went, homes):
        release(t)
    return inside.union(out)


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Returns doc_id, key, n_shingles, component_id and keeper (the key of the row that names the component: smallest doc_id,
    then key), a row for each row of docs (doc_id long, key long, text)."""
    rule = Rule(words, percent)
    facts = _facts(docs, rule)
    parts = facts.where("part is not null")
    histogram = added(parts.select("part", "counts"), max(1, parts.groupBy("part").count().agg(F.max("count")).first()[0] or 1), BUCKETS)
    facts = facts.where("part is null").select("doc_id", "key", "n", "node")
    prefixes = _prefixes(docs, rule, histogram)
    postings = _postings(prefixes)
    release(prefixes)
    first = written(_first_pairs(postings, rule))
    sets = _sets(docs, rule, _nodes(first), first)
    near = _near(first, sets, sets.where("b is not null").select(F.col("node").alias("a"), "b", F.col("tokens").alias("a_set")))
    members = _stars(near, sets, rule)
    links = written(_linked(near.where(100 * (F.col("n") - F.size("has")) >= rule.percent * (F.col("size") + F.size("has"))), members))
    release(first), release(near)
    labels = components(links)
    second = _second_pairs(postings.join(sets.select("node"), "node", "left_semi"), rule, labels, members)
    links = links.union(_links(second, sets, rule))
    release(labels)
    labels = components(links)
    links = links.union(_other_links(docs, postings, labels, members, sets, rule))
    release(labels), release(postings), release(sets), release(members)
    comps = components(links)
    first_of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    smallest = facts.where("n > 0").groupBy("node").agg(first_of)
    named = written(smallest.join(comps, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp")))
    names = named.groupBy("comp").agg(F.min("first").alias("first"))
    per = written(named.select("node", "comp").join(names, "comp").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("keeper")))
    release(named), release(comps)
    n = F.col("n").alias("n_shingles")
    linked = facts.where("n > 0").join(per, "node").select("doc_id", "key", n, "component_id", "keeper")
    return linked.union(facts.where("n = 0").select("doc_id", "key", n, F.col("doc_id").alias("component_id"), F.col("key").alias("keeper")))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Returns doc_id, n_shingles and component_id (the smallest doc_id that can be reached over links), a row for each
    row of docs.

    Texts are whole; A-Z counts as a-z. A text with fewer words than a shingle is one shingle; one without words, or
    null, has an empty set and is its own component. Documents with equal sets are linked. Rows that repeat an id
    count each; null ids do not name a component unless it has no other. No rows give no rows; columns besides doc_id
    and text are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return classes(rows, words, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without those of a class (see join) but one: that with the smallest doc_id
    (a null one comes last), of several texts with that id the one with the smallest hash, and of equal ones any.

    Rows without words, or with a null text, all stay. A row is known by doc_id and a hash of its text, so rows that share an id but
    not a text are judged apart. Only ids and hashes are shuffled for this; texts meet the few keys to drop in a join.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text = F.col("_doc.text").cast("string")
    rows = rows.withColumns({"_id": F.col("_doc.doc_id").cast("long"), "_key": F.xxhash64(text)})
    found = classes(rows.select(F.col("_id").alias("doc_id"), F.col("_key").alias("key"), text.alias("text")), words, percent).where("n_shingles > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("keeper"))
    goes = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias("g_id"), F.col("doc_id").isNull().alias("g_none"), F.col("key").alias("g_key")).agg(F.count("*").alias("rows"), F.min(stays).alias("stays")).where("rows > 1 or not stays")
    goes = written(goes)
    same = (F.coalesce("_id", F.lit(0)) == F.col("g_id")) & (F.col("_id").isNull() == F.col("g_none")) & (F.col("_key") == F.col("g_key"))
    kept = rows.join(goes, same, "left_anti").select("_doc.*")
    again = goes.where("stays")
    if again.isEmpty():
        return kept
    one = rows.join(again, same).groupBy("g_id", "g_none", "g_key").agg(F.first("_doc").alias("_doc"))
    return kept.union(one.select("_doc.*"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), words=3, percent=90)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN array_to_string(w[i:i + 2], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.m), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id, n.n
"""
