"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Equal vectors are one node (with its smallest ids, as many as an answer can hold). A first graph joins nodes that
share a random-hyperplane code; the nodes of a crowded code are halved by further hyperplanes, each through the middle
of its group, until no group is crowded. NN-descent then improves the graph by joins: every node's neighbours, and the
best of those whose neighbour it is, meet with their vectors, each takes the nearest it met, and all that a node took is
merged into its K nearest. Rounds go on until fewer than SETTLED of all neighbour entries change. Vectors travel as
16-bit integers with one common scale, so squared distances are exact integers and equal however they are formed.

A query starts from its own node and expands the best nodes of its beam that are not expanded yet, until all of its beam
are expanded; a hop is one join of the frontier with the adjacency (neighbours' ids and vectors in one row). Every node
of the beam that the rounding to 16 bits leaves a chance to be among the answers is measured again in double precision
on the original vectors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dendrium.llm.common import release, table, written

K, TAKEN, TREES, GROUP, SETTLED = 24, 12, 2, 256, 0.001
BEAM, EXPANDED = 640, 320
SEED = 20240229


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _grouped(batches, key: str):
    """Record batches sorted by key as one batch for each run of whole groups."""
    import pyarrow as pa

    kept = None
    for batch in batches:
        whole = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0] if kept is not None and kept.num_rows else batch
        keys = whole.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield whole.slice(0, cut)
        kept = whole.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def _binary(column, width: int) -> np.ndarray:
    """A binary column of equally long values as rows of int16; width counts bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, width // 2)


def _local_join(rows: DataFrame, group: str, take: int) -> DataFrame:
    """For (group, node, vec): in each group, each node takes the nearest others: (node, near array of (score, id)); the
    score is the negative squared distance."""
    rows = rows.repartition(F.col(group)).sortWithinPartitions(group)

    def run(batches):
        import pyarrow as pa

        for batch in _grouped(batches, group):
            keys, nodes = batch.column(group).to_numpy(), batch.column("node").to_numpy()
            vec = _binary(batch.column("vec"), len(batch.column("vec")[0].as_py())).astype(np.float64)
            square = (vec * vec).sum(axis=1)
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            out_node, out_n, out_id, out_score = [], [], [], []
            for a, b in zip(edges, edges[1:], strict=False):
                n = b - a
                m = min(take, n - 1)
                if m < 1:
                    continue
                s = 2 * (vec[a:b] @ vec[a:b].T) - square[a:b, None] - square[a:b]  # exact: integers below 2**53
                np.fill_diagonal(s, -np.inf)
                best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < n - 1 else np.array([[j for j in range(n) if j != i] for i in range(n)])
                out_node.append(nodes[a:b])
                out_n.append(np.full(n, m))
                out_id.append(nodes[a:b][best].reshape(-1))
                out_score.append(np.take_along_axis(s, best, 1).reshape(-1))
            if out_node:
                near = pa.StructArray.from_arrays([pa.array(np.concatenate(out_score).astype(np.int64)), pa.array(np.concatenate(out_id))], names=["score", "id"])
                ends = np.concatenate(([0], np.cumsum(np.concatenate(out_n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_node)), pa.ListArray.from_arrays(pa.array(ends), near)], names=["node", "near"])

    return rows.mapInArrow(run, "node long, near array<struct<score:long,id:long>>")


def _merged(taken: DataFrame, k: int) -> DataFrame:
    """The k nearest of all that each node took. (array_distinct compares all pairs of structs; equal ones are neighbours
    once they are sorted.)"""
    every = taken.groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("near")), asc=False).alias("every"))
    new = F.filter("every", lambda e, i: (i == 0) | (F.get(F.col("every"), i - 1) != e))
    return every.select("node", F.slice(new, 1, k).alias("near"))


def _around(graph: DataFrame, k: int) -> DataFrame:
    """(v, node): each node's neighbours, the k best of those whose neighbour it is, and itself."""
    edges = graph.select(F.col("node").alias("v"), F.explode("near").alias("e")).select("v", F.col("e.id").alias("node"), F.col("e.score").alias("score"))
    back = edges.select(F.col("node").alias("v"), F.col("v").alias("node"), "score").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "node"))).where(F.col("r") <= k)
    return edges.select("v", "node").union(back.select("v", "node")).union(graph.select(F.col("node").alias("v"), "node")).distinct()


def nodes_of(vectors: DataFrame, answers: int) -> DataFrame:
    """(node, members, embedding): one row for each different usable vector of the most frequent length; node is its
    smallest id, members the smallest ids with that vector, answers + 1 at most."""
    ok = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    dims = ok.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    ok = ok.where(F.size("embedding") == (dims.d if dims else 0))
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = ok.withColumn("r", rank).where(F.col("r") <= answers + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("node"), "members", "embedding")


def _uncrowded(coded: DataFrame, units: DataFrame, d: int) -> DataFrame:
    """For (node, codes) and (node, x): (leaf, node), groups of GROUP nodes at most for each tree. Each level halves all
    crowded groups at the mean of their projections on a new direction, another for each tree, so dense groups are split
    like wide ones and the trees cut them in different places; only nodes that double precision cannot tell apart are dealt by hash."""
    directions = np.random.default_rng(SEED + 1)
    rows = coded.select("node", F.posexplode("codes").alias("tree", "code")).select("node", "tree", F.xxhash64("tree", "code").alias("leaf"))
    parts = []
    while True:
        sized = written(rows.join(rows.groupBy("leaf").agg(F.count("*").alias("n")), "leaf"))
        parts.append(sized.where(F.col("n") <= GROUP).select("leaf", "node"))
        crowded = sized.where(F.col("n") > GROUP)
        if crowded.isEmpty():
            return reduce(DataFrame.union, parts)
        ways = [F.array(*[F.lit(float(v)) for v in w]) for w in directions.standard_normal((TREES, d))]
        at = written(crowded.join(units, "node").select("node", "tree", "leaf", "n", _dot(F.col("x"), F.get(F.array(*ways), F.col("tree"))).alias("at")))
        middle = at.groupBy("leaf").agg(F.avg("at").alias("mid"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        halved = at.join(F.broadcast(middle), "leaf")
        apart = (F.col("lo") <= F.col("mid")) & (F.col("mid") < F.col("hi"))
        parts.append(halved.where(~apart).select(F.xxhash64("leaf", F.pmod(F.xxhash64("node", "leaf"), F.ceil(F.col("n") / GROUP))).alias("leaf"), "node"))
        rows = written(halved.where(apart).select("node", "tree", F.xxhash64("leaf", F.col("at") > F.col("mid")).alias("leaf")))


def _changed(new: DataFrame, old: DataFrame) -> float:
    """The share of neighbour entries of new that old does not have."""
    ids = lambda near: F.transform(near, lambda e: e["id"])
    both = new.join(old.select("node", F.col("near").alias("was")), "node", "left")
    added = F.size(F.array_except(ids(F.col("near")), F.coalesce(ids(F.col("was")), F.array().cast("array<long>"))))
    sums = both.agg(F.sum(added).alias("added"), F.sum(F.size("near")).alias("all")).first()
    return (sums.added or 0) / (sums["all"] or 1)


def build(nodes: DataFrame, k: int = K, settled: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """The 16-bit vectors (node, vec) and the graph (node, near) of nodes, both written."""
    spark = nodes.sparkSession
    unit = F.transform("embedding", lambda x: x / F.sqrt(_dot(F.col("embedding"), F.col("embedding"))))
    first = nodes.select(F.max(F.array_max(F.transform(unit, lambda x: F.abs(x)))).alias("top"), F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    scale, n, d = 32767.0 / (first.top or 1.0), first.n, first.d or 1
    bits = max(0, int(np.ceil(np.log2(max(1, n) / GROUP))))
    planes = spark.sparkContext.broadcast(np.random.default_rng(SEED).standard_normal((d, TREES * max(1, bits))))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, d)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            sides = (x @ planes.value > 0).astype(np.int64).reshape(len(x), TREES, max(1, bits))
            codes = (sides << np.arange(max(1, bits))).sum(axis=2) if bits else np.zeros((len(x), TREES), np.int64)
            vec = np.clip(np.round(x * scale), -32767, 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v in vec], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))], names=["node", "vec", "codes"])

    coded = written(nodes.select("node", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "node long, vec binary, codes array<long>"))
    vectors = coded.select("node", "vec")
    leaves = _uncrowded(coded.select("node", "codes"), nodes.select("node", F.col("embedding").cast("array<double>").alias("embedding")).select("node", unit.alias("x")), d)
    graph = written(_merged(_local_join(leaves.join(vectors, "node").select("leaf", "node", "vec"), "leaf", k), k))
    while True:
        met = _around(graph, k).join(vectors, "node")
        new = written(_merged(_local_join(met.select("v", "node", "vec"), "v", TAKEN).union(graph), k))
        changed = _changed(new, graph)
        release(graph)
        graph = new
        if changed < settled:
            break
    return vectors, graph


def _adjacency(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(v, ids, vecs): the neighbours of each node, and their vectors one after another."""
    met = _around(graph, k).where("v != node").join(vectors, "node")
    both = met.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("node", "vec"))).alias("all"))
    return both.select("v", F.col("all.node").alias("ids"), F.array_join(F.transform("all", lambda e: F.hex(e["vec"])), "").alias("h")).select("v", "ids", F.unhex("h").alias("vecs"))


def _measure(rows: DataFrame) -> DataFrame:
    """For (q, vec, ids, vecs): (q, near), the scores of the ids."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                width = len(part.column("vec")[0].as_py())
                ids = part.column("ids")
                n = np.diff(np.asarray(ids.offsets))
                near = _binary(part.column("vecs"), width).astype(np.float64)
                near -= np.repeat(_binary(part.column("vec"), width).astype(np.float64), n, axis=0)
                score = -np.einsum("ij,ij->i", near, near).astype(np.int64)
                found = pa.StructArray.from_arrays([pa.array(score), ids.flatten()], names=["score", "id"])
                yield pa.RecordBatch.from_arrays([part.column("q"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), found)], names=["q", "near"])

    return rows.mapInArrow(run, "q long, near array<struct<score:long,id:long>>")


def search(vectors: DataFrame, graph: DataFrame, starts: DataFrame, answers: int, beam: int = BEAM, expanded: int = EXPANDED, k: int = K) -> DataFrame:
    """For starts (q): (q, ids), the nodes of the final beam that can be among the nearest `answers`; q itself is not
    among them. Rounding moves a distance by sqrt(dimensions) at most, in units of the scale."""
    nearby = _adjacency(graph, vectors, k).repartition(F.col("v")).persist()
    asked = written(starts.join(vectors, starts.q == vectors.node).select("q", "vec"))
    state = asked.select("q", "vec", F.array().cast("array<struct<score:long,id:long>>").alias("beam"), F.array().cast("array<long>").alias("done"), F.array("q").alias("next"))
    while True:
        met = state.select("q", "vec", F.explode("next").alias("v")).join(nearby, "v")
        found = _measure(met.select("q", "vec", "ids", "vecs")).union(state.select("q", F.col("beam").alias("near")))
        best = _merged(found.withColumnRenamed("q", "node"), beam + 1).select(F.col("node").alias("q"), F.filter("near", lambda e: e["id"] != F.col("node")).alias("beam"))
        done = F.concat("done", "next")
        new = written(
            best.join(state.select("q", "vec", done.alias("done")), "q")
            .select("q", "vec", "beam", "done", F.slice(F.array_except(F.transform("beam", lambda e: e["id"]), "done"), 1, expanded).alias("next"))
        )
        release(state)
        state = new
        if state.where(F.size("next") > 0).isEmpty():
            break
    nearby.unpersist()
    release(asked)
    distance = lambda e: F.sqrt(-e["score"])
    last = distance(F.get(F.col("beam"), F.least(F.lit(answers), F.size("beam")) - 1))
    within = last + 2 * F.sqrt(F.length("vec") / 2) + 1
    return state.select("q", F.transform(F.filter("beam", lambda e: distance(e) <= within), lambda e: e["id"]).alias("ids"))


def nearest(embeddings: DataFrame, every: int, answers: int = 5) -> DataFrame:
    """Returns query_id, rank, vec_id and score (cosine in double precision): for each row whose vec_id is divisible by
    `every`, the nearest other rows found, ties to the smaller vec_id.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; nor
    do rows without an id. A row repeated with its id counts as another row with that vector. Fewer rows give fewer
    answers, no rows none; columns besides vec_id and embedding are not looked at.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    nodes = written(nodes_of(rows, answers))
    vectors, graph = build(nodes)
    queries = rows.where((F.col("vec_id") % every == 0) & usable(F.col("embedding"))).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = written(queries.join(nodes.select("node", "embedding"), "embedding").select("query_id", F.col("node").alias("q")))
    starts = asked.select("q").distinct()
    found = search(vectors, graph, starts, answers)
    pairs = found.select("q", F.explode(F.concat(F.array("q"), "ids")).alias("node"))
    exact = nodes.select("node", "members", F.col("embedding").cast("array<double>").alias("x"))
    mine = exact.select(F.col("node").alias("q"), F.col("x").alias("y"))
    score = _dot(F.col("x"), F.col("y")) / (F.sqrt(_dot(F.col("x"), F.col("x"))) * F.sqrt(_dot(F.col("y"), F.col("y"))))
    scored = pairs.join(exact, "node").join(mine, "q").select("q", F.transform("members", lambda m: F.struct((-score).alias("far"), m.alias("vec_id"))).alias("near"))
    top = written(scored.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, answers + 1).alias("near")))
    own = asked.join(top, "q").select("query_id", F.col("near"))
    # one entry for the query itself goes; if its id is not among them, the last is one too many
    at = F.array_position(F.transform("near", lambda e: e["vec_id"]), F.col("query_id"))
    kept = F.when(at > 0, F.concat(F.slice("near", F.lit(1), (at - 1).cast("int")), F.slice("near", (at + 1).cast("int"), F.lit(answers + 1)))).otherwise(F.slice("near", 1, answers))
    return own.select("query_id", F.posexplode(kept).alias("i", "e")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.far")).alias("score"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50)
