"""The near-copy join against all pairs, on groups of every shape."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dendrium.llm import jaccard_join, shingles

from test_operators import DOCS, brute_classes


def edited(rng, words, most):
    """Words after up to `most` replacements, deletions, insertions or cuts."""
    w = list(words)
    for _ in range(rng.randint(0, most)):
        at, how = rng.randrange(len(w)), rng.random()
        if how < 0.5:
            w[at] = f"x{rng.randrange(500)}"
        elif how < 0.7 and len(w) > 3:
            del w[at]
        elif how < 0.9:
            w.insert(at, f"y{rng.randrange(5)}")
        else:
            w = w[: max(3, len(w) - rng.randint(1, 6))]
    return w


def groups(seed, each=70):
    """Near copies of three texts, copies of an odd copy, cuts of one text, and texts that share a passage."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    bases = [rng.choices(vocab, k=60), rng.choices(vocab, k=45), rng.choices(vocab, k=90)]
    odd = edited(rng, bases[0], 14)
    passage = rng.choices(vocab, k=25)
    texts = [edited(rng, b, 9) for b in bases for _ in range(each)]
    texts += [edited(rng, odd, 6) for _ in range(each)] + [bases[2][: 90 - i] for i in range(40)]
    texts += [rng.choices(vocab, k=rng.randint(1, 30)) + passage for _ in range(40)] + [bases[0]] * 5
    return [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("words", "percent", "crowded", "fan"), [(3, 90, 32, 400), (3, 75, 2, 5), (1, 60, 1, 7)])
def test_groups(spark, monkeypatch, words, percent, crowded, fan):
    monkeypatch.setattr(jaccard_join, "CROWDED", crowded)
    monkeypatch.setattr(jaccard_join, "FAN", fan)
    rows = groups(words * 100 + percent)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert Counter(map(tuple, jaccard_join.join(df, words, percent).collect())) == brute_classes(rows, words, percent)


@pytest.mark.parametrize("near", [95])
def test_any_star_is_right(spark, monkeypatch, near):
    """What counts as near a middle is a matter of cost."""
    monkeypatch.setattr(jaccard_join, "NEAR", near)
    rows = groups(5, 40)
    assert Counter(map(tuple, jaccard_join.join(spark.createDataFrame(rows, DOCS), 3, 80).collect())) == brute_classes(rows, 3, 80)


def test_blocks_do_not_show(monkeypatch):
    rng = random.Random(3)
    texts = pa.array(["".join(rng.choices("abC d\n", k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "x" * 500, " " * 90, "é" * 33 + " z"])
    whole = shingles.word_hashes(texts)
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(shingles, "BLOCK", block)
        parts = shingles.word_hashes(texts)
        assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_rows_that_share_an_id(spark):
    """A row is known by id and text; of each class one row stays."""
    a, b, c = ("the first text of all", "another text that is long enough", "a third one of some words here")
    rows = [(5, a), (3, a), (5, b), (5, c), (5, c), (None, c), (None, "five words that stand alone"), (None, None), (7, None), (7, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)), 2, 80)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, a), (5, b), (5, c), (None, "five words that stand alone"), (None, None), (7, None), (7, "")])


def test_stars_merge(spark):
    """A star goes over to a near one with more members, if all of its own are near that middle; others stay."""
    rule = jaccard_join.Rule(3, 80)
    tokens = {1: range(100), 2: range(5, 105), 3: range(20, 120), 4: range(900, 1000), 5: range(30, 130), 6: range(60, 160)}  # 6 is near 5, not 1
    sets = spark.createDataFrame([(k, list(v)) for k, v in tokens.items()], "node long, tokens array<long>")
    own = [(a, b, 100, sorted({*tokens[b]} - {*tokens[a]}), sorted({*tokens[a]} - {*tokens[b]}), True) for a, b in ((2, 1), (6, 5))]
    members = spark.createDataFrame([*own, (10, 1, 100, [1], [777], False)], "node long, star long, n int, lacks array<long>, has array<long>, border boolean")
    reach = spark.createDataFrame([(1, 3, True), (1, 4, False), (1, 5, True)], "star long, star2 long, near boolean")
    out, went, homes = jaccard_join._merged_stars(reach, members, sets, rule)
    assert [tuple(r) for r in homes.collect()] == [(3, 1)]
    assert [(r.node, r.star, r.n, sorted(r.lacks), sorted(r.has), r.border) for r in went.collect()] == [(3, 1, 100, list(range(20)), list(range(100, 120)), True)]
    assert sorted((r.node, r.star) for r in out.collect()) == [(2, 1), (3, 1), (6, 5), (10, 1)]


def test_a_star_does_not_meet_on_what_all_have(spark):
    """Members with a passage in common that do not link, and two that do: these meet, on few rows."""
    rule, passage = jaccard_join.Rule(3, 90), list(range(1000, 1030))
    has = {x: [*passage, *(5000 + 20 * (x // 2 if x < 2 else x) + i for i in range(15))] for x in range(60)}  # 0 and 1 are alike
    rows = [(x, x, True, 190, 5, 45, t) for x, ts in has.items() for t in ts]
    rows = spark.createDataFrame(rows, "node long, comp long, border boolean, n int, a int, b int, token long").withColumn("star", F.lit(1).cast("long"))
    mixed = rows.groupBy("star", "token").agg(F.count("*").alias("f"), F.min("n").alias("low")).where("f > 1")
    first = jaccard_join._first_of_has(rows.join(mixed, ["star", "token"]), rule).collect()
    met = {}
    for r in first:
        met.setdefault(r.token, set()).add(r.node)
    assert any({0, 1} <= nodes for nodes in met.values())
    assert sum(len(nodes) ** 2 for nodes in met.values()) < 100  # 30 * 60 * 60 on the whole passage


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_classes_of_sizes(spark, percent):
    """A posting is in few rows, and sizes that may link meet in exactly one class."""
    rule = jaccard_join.Rule(3, percent)
    rows = spark.range(1, 400).select(F.col("id").alias("node"), F.col("id").cast("int").alias("n"), F.lit(1).alias("k"), F.lit(10**6).alias("cnt"))
    got = jaccard_join._by_class(rows, rule)
    assert got.groupBy("node").count().agg(F.max("count")).first()[0] <= 5
    x, y = got.select("n", "own", "lo", "hi"), got.select(F.col("n").alias("m"), F.col("own").alias("own2"), "lo", "hi")
    met = x.join(y, ["lo", "hi"]).where((F.col("lo") == F.col("hi")) | (F.col("own") != F.col("own2"))).where(f"100 * n >= {percent} * m and 100 * m >= {percent} * n").groupBy("n", "m").count()
    assert met.where("count != 1").isEmpty()
    assert met.count() == sum(100 * n >= percent * m and 100 * m >= percent * n for n in range(1, 400) for m in range(1, 400))
