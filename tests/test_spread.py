"""Partitions follow the rows; sentences of pairs; trees from lines that meet once."""

import pytest
from pyspark.sql import functions as F

from dendrium.operators import evaluate, heads, ranking, staging, textsearch
from dendrium.sources import relations


@pytest.mark.parametrize("choice", [ranking.most_probable_parse, lambda d: ranking.sl_dop(d, 2)])
def test_partitions_follow_the_rows(spark, monkeypatch, choice):
    monkeypatch.setattr(staging, "PART_ROWS", 100)
    d = spark.range(1000).select((F.col("id") % 300).alias("sent"), F.concat(F.lit("t"), F.col("id") % 7).alias("tree"), (F.col("id") % 5).alias("nfrags"), (F.col("id") % 11 / 3).alias("cost"))
    assert choice(d).rdd.getNumPartitions() == 10
    assert choice(d).count() == 300


def test_exact_of_pairs_alone(spark):
    rows = lambda x: spark.createDataFrame(x, "sentno int, label string, leaves array<int>")
    gold = rows([(1, "A", [0]), (1, "B", [0, 1]), (2, "A", [0]), (3, "A", [0])])
    other = rows([(1, "A", [0]), (1, "B", [0, 1]), (2, "B", [0]), (9, "A", [0])])
    pairs = evaluate.paired(gold, other)
    assert evaluate.exact(pairs).collect() == evaluate.exact(pairs, gold, other).collect()
    assert [tuple(r) for r in evaluate.exact(pairs).collect()] == [(3, 2, 1)]


def test_counted_words(spark):
    lexicon = spark.createDataFrame([("en", "a", 1.0), ("de", "a", 2.0), ("de", "b", 1.0)], "model string, word string, cost double")
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "z")], "sent int, word string")
    counted = tokens.groupBy("sent", "word").agg(F.count("*").alias("k"))
    got = {r.sent: r.model for r in textsearch.guess_language(counted, lexicon).collect()}
    assert got == {r.sent: r.model for r in textsearch.guess_language(tokens, lexicon).collect()} == {1: "en", 2: "de", 3: None}


def test_orders_meet_once(spark):
    sf = "/root/testdata/sf0.001"
    plan = relations.factored_nodes(spark, sf, words=True)._jdf.queryExecution().toString()
    assert "Window" not in plan
    items = relations.order_items(spark, sf).groupBy("corpus", "sentno", "root").agg(F.sort_array(F.collect_list(F.struct("ix", "label", "word"))).alias("items"))
    want = items.select("corpus", "sentno", "root", F.size("items").alias("n"), F.transform("items", lambda i: F.struct(i["label"].alias("label"), i["word"].alias("word"))).alias("items"))
    got = relations.order_rows(spark, sf)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_kinds_do_not_join_their_rules(spark):
    nodes = relations.flat_nodes(spark, "/root/testdata/sf0.001")
    found = nodes.where("parent is null").select("corpus", "sentno", "nid", F.lit(1).alias("head"))
    assert "LeftSemi" not in heads.kinds(nodes, found, "* NF AF")._jdf.queryExecution().toString()
