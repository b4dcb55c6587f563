"""Tree transformations that are plain table operations. What rewrites the structure of single trees is in
dendrium.functions.treetools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["corpus", "sentno"]


def parent_annotation(nodes: DataFrame, mark: str = "^") -> DataFrame:
    """Labels of nodes that are no words, with their parents' labels."""
    up = nodes.select(*[F.col(k).alias(f"p_{k}") for k in KEY], F.col("nid").alias("p_nid"), F.col("label").alias("p_label"))
    on = (F.col("corpus") == F.col("p_corpus")) & (F.col("sentno") == F.col("p_sentno")) & (F.col("parent") == F.col("p_nid"))
    new = F.when(F.col("p_label").isNull() | F.col("is_word"), F.col("label")).otherwise(F.concat("label", F.lit(mark), "p_label"))
    return nodes.join(up, on, "left").withColumn("label", new).drop("p_corpus", "p_sentno", "p_nid", "p_label")


def split_discontinuous(leaves: DataFrame) -> DataFrame:
    """For (sentno, label, leaf): (sentno, label, leaves), one node L*k for each span of a node with several."""
    run = F.col("leaf") - F.row_number().over(Window.partitionBy("sentno", "label").orderBy("leaf"))
    parts = leaves.withColumn("run", run).groupBy("sentno", "label", "run").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    k = F.row_number().over(Window.partitionBy("sentno", "label").orderBy(F.col("leaves")[0])) - 1
    n = F.count("*").over(Window.partitionBy("sentno", "label"))
    x = parts.withColumns({"k": k, "n": n})
    return x.select("sentno", F.when(F.col("n") > 1, F.concat("label", F.lit("*"), F.col("k").cast("string"))).otherwise(F.col("label")).alias("label"), "leaves")


def merge_discontinuous(parts: DataFrame) -> DataFrame:
    """The inverse of split_discontinuous."""
    plain = F.regexp_replace("label", r"\*[0-9]*$", "")
    return parts.groupBy("sentno", plain.alias("label")).agg(F.sort_array(F.flatten(F.collect_list("leaves"))).alias("leaves"))


def fanout_markers(nodes: DataFrame) -> DataFrame:
    """Labels of nodes with several spans get _n."""
    return nodes.select("sentno", F.when(F.col("fanout") > 1, F.concat("label", F.lit("_"), F.col("fanout").cast("string"))).otherwise(F.col("label")).alias("label"))


def without_markers(label: Column) -> Column:
    return F.regexp_replace(label, "_[0-9]+$", "")


def remove_words(nodes: DataFrame, goes: Column) -> DataFrame:
    """(corpus, sentno, nid, word, pos): words that stay, numbered anew."""
    pos = F.row_number().over(Window.partitionBy(*KEY).orderBy("nid")) - 1
    return nodes.where(F.col("is_word") & ~goes).select(*KEY, "nid", "word", pos.alias("pos"))


def kept_nodes(nodes: DataFrame, goes: Column) -> DataFrame:
    """Nodes over at least one word that stays."""
    w = nodes.where(F.col("is_word") & ~goes).select(*[F.col(k).alias(f"w_{k}") for k in KEY], F.col("nid").alias("w_nid"))
    on = (F.col("corpus") == F.col("w_corpus")) & (F.col("sentno") == F.col("w_sentno")) & (F.col("nid") < F.col("w_nid")) & (F.col("w_nid") <= F.col("last"))
    return nodes.where(~F.col("is_word")).join(w, on, "left_semi")


def canonical_order(leaves: DataFrame) -> DataFrame:
    """(sentno, leaf, new): places of the words once each node's words stand together, nodes by their first."""
    first = leaves.groupBy("sentno", "label").agg(F.min("leaf").alias("lo"))
    new = F.row_number().over(Window.partitionBy("sentno").orderBy("lo", "leaf")) - 1
    return leaves.join(first, ["sentno", "label"]).select("sentno", "leaf", new.alias("new"))


def heads(children: DataFrame, priority: list[str], from_right: bool = False) -> DataFrame:
    """(corpus, sentno, parent, head): the child whose label comes first in the list, then the first from the side."""
    rank = F.lit(len(priority) + 1)
    for i, label in reversed(list(enumerate(priority, 1))):
        rank = F.when(F.col("label") == label, i).otherwise(rank)
    side = -F.col("ix") if from_right else F.col("ix")
    best = children.groupBy(*KEY, "parent").agg(F.min_by("nid", F.struct(rank, side)).alias("head"))
    return best.select(*KEY, "parent", "head")


def levels(nodes: DataFrame, cases: list[tuple[Column, int]], otherwise: int) -> DataFrame:
    """(corpus, sentno, level): the first case (an aggregate condition) that holds for a sentence."""
    out = F.lit(otherwise)
    for condition, level in reversed(cases):
        out = F.when(condition, level).otherwise(out)
    return nodes.groupBy(*KEY).agg(out.alias("level"))
