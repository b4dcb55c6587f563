"""Choosing among derivations: (sent, tree, nfrags, cost) with cost = -ln p."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from dendrium.operators import batches
from dendrium.operators.staging import spread


def log_sum(cost: Column) -> Column:
    """Aggregate: -ln of the summed probabilities (shifted by the least cost, so that nothing underflows)."""
    costs = F.collect_list(cost)
    low = F.array_min(costs)
    return low - F.log(F.aggregate(F.sort_array(costs), F.lit(0.0), lambda s, x: s + F.exp(low - x)))


def most_probable_derivation(d: DataFrame) -> DataFrame:
    return d.groupBy("sent").agg(F.min_by("tree", F.struct("cost", "tree")).alias("tree"), F.min("cost").alias("cost"))


def most_probable_parse(d: DataFrame) -> DataFrame:
    """The tree whose derivations together are most probable. All of it is within sentences, which are moved once."""
    low = Window.partitionBy("sent")
    x = spread(d.select("sent", "tree", "cost"), "sent").withColumn("low", F.min("cost").over(low)).groupBy("sent", "tree").agg(F.sum(F.exp(F.col("low") - F.col("cost"))).alias("mass"), F.first("low").alias("low"))
    best = x.groupBy("sent").agg(F.max_by(F.struct("tree", "mass", "low"), F.struct(F.round("mass", 12), F.col("tree"))).alias("b"))
    return best.select("sent", F.col("b.tree").alias("tree"), (F.col("b.low") - F.log("b.mass")).alias("cost"))


def shortest_derivation(d: DataFrame) -> DataFrame:
    """Fewest fragments, then least cost."""
    return d.groupBy("sent").agg(F.min(F.struct("nfrags", "cost", "tree")).alias("b")).select("sent", "b.tree", "b.nfrags", "b.cost")


def k_best(d: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("sent").orderBy("cost", "nfrags", "tree"))
    return d.withColumn("rank", r).where(F.col("rank") <= k)


def sl_dop(d: DataFrame, n: int) -> DataFrame:
    """Among the n most probable trees, the one with the shortest derivation. All of it is within sentences, which are moved once."""
    low = F.min("cost").over(Window.partitionBy("sent"))
    x = spread(d.select("sent", "tree", "nfrags", "cost"), "sent").withColumn("low", low).groupBy("sent", "tree").agg(F.sum(F.exp(F.col("low") - F.col("cost"))).alias("mass"), F.min(F.struct("nfrags", "cost")).alias("b"))
    r = F.row_number().over(Window.partitionBy("sent").orderBy(F.desc(F.round("mass", 12)), "tree"))
    top = x.withColumn("r", r).where(F.col("r") <= n)
    return top.groupBy("sent").agg(F.min(F.struct("b", "tree")).alias("m")).select("sent", "m.tree", F.col("m.b.nfrags").alias("nfrags"))


def beam(items: DataFrame, cell: list[str], beta: float) -> DataFrame:
    """Items not worse than the best of their cell by more than beta."""
    return items.withColumn("low", F.min("cost").over(Window.partitionBy(*cell))).where(F.col("cost") <= F.col("low") + beta).drop("low")


def rerank(d: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The k cheapest trees of each sentence in the order of a second model (sent, tree, cost2)."""
    x = k_best(d, k).select("sent", "tree").distinct().join(second, ["sent", "tree"])
    return x.groupBy("sent").agg(F.min_by("tree", F.struct("cost2", "tree")).alias("tree"))


def span_marginals(brackets: DataFrame) -> DataFrame:
    """(sent, s, e, label, q): for each span of the derivations' brackets (sent, derivation, cost, label, s, e) the label that most of the
    probability has there, and how much of the sentence's it is. Of equal ones the last label by name is taken; a derivation's repeated brackets count once."""
    x = brackets.select("sent", "derivation", "cost", "label", "s", "e").repartition("sent").distinct()  # moved once: all below is within sentences
    one, sentence = Window.partitionBy("sent", "derivation"), Window.partitionBy("sent")
    x = x.withColumns({"cost": F.min("cost").over(one), "nth": F.row_number().over(one.orderBy("s", "e", "label"))})
    x = x.withColumn("w", F.exp(F.min("cost").over(sentence) - F.col("cost"))).withColumn("total", F.sum(F.when(F.col("nth") == 1, F.col("w"))).over(sentence))
    q = x.groupBy("sent", "s", "e", "label").agg(F.sum("w").alias("w"), F.first("total").alias("total")).withColumn("q", F.round(F.col("w") / F.col("total"), 12))
    return q.groupBy("sent", "s", "e").agg(F.max(F.struct("q", "label")).alias("b")).select("sent", "s", "e", "b.label", "b.q")


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _spans(table: pa.Table, sent: np.ndarray) -> tuple[np.ndarray, ...]:
    """span_marginals() of whole sentences: (row, sent, s, e, q) by sent, s and e; row is one of the table with the span's label."""
    s, e = (batches.ints(table[c])[0] for c in ("s", "e"))
    cost = table["cost"].to_numpy().astype(float)
    one = np.unique(batches.codes(table["derivation"]) + 1 + sent * (table.num_rows + 1), return_inverse=True)[1]
    names = table["label"].combine_chunks().dictionary_encode()
    rank = np.zeros(len(names.dictionary) + 1, np.int64)
    rank[sorted(range(len(names.dictionary)), key=[x.encode() for x in names.dictionary.to_pylist()].__getitem__)] = np.arange(1, len(rank))
    label = rank[names.indices.fill_null(len(rank) - 1).to_numpy()]  # nulls come first
    order = np.lexsort((cost, one, label, e, s, sent))
    sent, s, e, label, one, cost = (x[order] for x in (sent, s, e, label, one, cost))
    new = np.zeros(len(order), bool)  # another span or label
    for x in (sent, s, e, label):
        new |= np.r_[True, x[1:] != x[:-1]][: len(order)]
    same = ~new & ~np.r_[True, (one[1:] != one[:-1]) | (cost[1:] != cost[:-1])][: len(order)]
    order, sent, s, e, label, one, cost, new = (x[~same] for x in (order, sent, s, e, label, one, cost, new))
    least = np.full(one.max(initial=-1) + 1, np.inf)
    np.fmin.at(least, one, cost)
    of = np.zeros(len(least), np.int64)
    of[one] = sent
    low, total = np.full(sent.max(initial=-1) + 1, np.inf), np.zeros(sent.max(initial=-1) + 1)
    np.fmin.at(low, of, least)
    w = np.exp(low[of] - least)
    np.add.at(total, of, w)
    first = np.flatnonzero(new)
    q = _rounded(np.add.reduceat(w[one], first) / total[sent[first]], 12) if len(first) else np.zeros(0)
    order, sent, s, e, label = (x[first] for x in (order, sent, s, e, label))
    by = np.lexsort((label, q, e, s, sent))
    order, sent, s, e, q = (x[by] for x in (order, sent, s, e, q))
    last = np.ones(len(order), bool)
    last[:-1] = (sent[1:] != sent[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return tuple(x[last] for x in (order, sent, s, e, q))


def _best_trees(table: pa.Table, sent: np.ndarray) -> pa.Table:
    row, sent, s, e, q = _spans(table, sent)
    size = e - s
    wide = e.max(initial=0) + 1
    places = batches.Places(sent, s * wide + e)
    # All splits of all spans: a shorter span from the same place, and what is from its end to the span's.
    shorter = batches.places_in(batches.dense(sent, s)) if len(s) else size
    span = np.repeat(np.arange(len(s)), shorter)
    left = span - np.repeat(np.cumsum(shorter), shorter) + np.arange(len(span))
    right = places.at(sent[span], e[left] * wide + e[span], s[span] < e[left])
    span, left, right = (x[right >= 0] for x in (span, left, right))
    by = np.argsort(size[span], kind="stable")
    span, left, right = span[by], left[by], right[by]
    score, lower = np.where(size == 1, q, np.nan), np.full((len(s), 2), -1)
    sizes, begin = np.unique(size[span], return_index=True)
    for a, b in zip(begin, [*begin[1:], len(span)][: len(begin)], strict=True):
        x, y, z = span[a:b], left[a:b], right[a:b]
        total = _rounded(score[y] + score[z], 9)
        built = ~np.isnan(total)
        x, y, z, total = x[built], y[built], z[built], total[built]
        by = np.lexsort((e[y], total, x))
        best = by[np.r_[x[by][1:] != x[by][:-1], np.ones(min(1, len(by)), bool)]]
        score[x[best]] = q[x[best]] + total[best]
        lower[x[best], 0], lower[x[best], 1] = y[best], z[best]
    end = np.zeros(sent.max(initial=-1) + 1, np.int64)
    np.maximum.at(end, sent, e)
    whole = places.at(np.arange(len(end)), end)
    here = whole[whole >= 0]
    here = here[~np.isnan(score[here])]
    top, found, tops = here, [], []
    while len(here):
        found.append(here)
        tops.append(top)
        split = lower[here, 0] >= 0
        top, here = np.tile(top[split], 2), np.r_[lower[here[split], 0], lower[here[split], 1]]
    at, top = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, tops))
    out = table.select(["sent", "label", "s", "e"]).take(pa.array(row[at]))
    return out.add_column(1, "score", pa.array(_rounded(score[top], 9)))


def max_constituents(brackets: DataFrame) -> DataFrame:
    """(sent, score, label, s, e): the binary tree, over spans that some derivation has, whose constituents have the most probability in
    sum; of equal splits the last. Brackets as for span_marginals(), one-word spans among them; a sentence whose longest span from 0
    cannot be built of two others has no rows. A sentence's brackets meet once; spans are built a length at a time, over many sentences at once, and
    trees are followed downwards at the end."""
    x = brackets.where("sent is not null and s is not null and e is not null").select("sent", "derivation", "cost", "label", "s", "e")
    kind = {f.name: f for f in x.schema}
    schema = StructType([kind["sent"], StructField("score", DoubleType()), kind["label"], kind["s"], kind["e"]])
    return batches.by_sentence(x, _best_trees, schema, ("s", "e"), ("sent",))
