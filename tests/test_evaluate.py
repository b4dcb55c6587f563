"""Evaluation with parameters against a plain evaluation of random trees, discontinuous ones too."""

import random
from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter

from dendrium.operators import evaluate
from dendrium.plans import queries

NODES = "corpus string, sentno long, nid long, parent long, depth int, label string, pos int, word string"
PARAMS = """
# remark
DELETE_LABEL X
DELETE_LABEL ,
DELETE_WORD gone
DELETE_LABEL_FOR_LENGTH ,
EQ_LABEL S T
EQ_LABEL T U
EQ_WORD a b
CUTOFF_LEN 4
"""


def random_tree(rng, words, tags):
    """A tree (label, children) over all positions; halves of a phrase may interleave."""

    def over(places, top):
        if len(places) == 1 and not top:
            return (tags[places[0] - 1], places[0])
        k = min(rng.choice([1, 2, 2, 3]), len(places))
        cut = [[] for _ in range(k)]
        for i, p in enumerate(places):
            cut[i if i < k else rng.randrange(k) if rng.random() < 0.4 else i * k // len(places)].append(p)
        if k == 1 and rng.random() < 0.7 and len(places) > 1:
            return over(places, top)
        kids = [over(c, False) if len(c) < len(places) or rng.random() < 0.9 else (rng.choice("XT"), tuple(over([p], False) for p in c)) for c in cut if c]
        return ("ROOT" if top else rng.choice("STUVX"), tuple(kids))

    return over(list(range(1, len(words) + 1)), True)


def rows_of(sentno, tree, words):
    out = []

    def walk(node, parent, depth):
        nid = len(out)
        leaf = isinstance(node[1], int)
        out.append(("c", sentno, nid, parent, depth, node[0], node[1] if leaf else None, words[node[1] - 1] if leaf else None))
        for k in [] if leaf else node[1]:
            walk(k, nid, depth + 1)

    walk(tree, None, 0)
    return out


def leaves(node):
    return [node[1]] if isinstance(node[1], int) else [x for k in node[1] for x in leaves(k)]


def bag(tree, stay, labeled, disc):
    """Brackets of a tree with the parameters applied by hand; stay is the ascending list of positions left."""
    number, out = {p: i for i, p in enumerate(stay)}, Counter()

    def walk(node, top):
        if isinstance(node[1], int):
            return
        at = tuple(sorted(number[x] for x in leaves(node) if x in number))
        label = node[0] if top else {"T": "S", "U": "S"}.get(node[0], node[0])
        gaps = any(b - a > 1 for a, b in zip(at, at[1:], strict=False))
        if at and label not in ("X", ",") and (gaps or not disc):
            out[label if labeled else "", at] += 1
        for k in node[1]:
            walk(k, False)

    walk(tree, True)
    return out


@pytest.mark.parametrize("more", ["", "LABELED 0", "DISC_ONLY 1", "DELETE_ROOT_PRETERMS 1"])
def test_parameters(spark, more):
    rng = random.Random(more)
    gold, other, want = [], [], {}
    for s in range(40):
        n = rng.choice([1, 2, 4, 5, 7])
        words = [rng.choice(["a", "b", "c", "gone"]) for _ in range(n)]
        tags = [rng.choice(["N", "V", ",", "X"]) for _ in range(n)]
        g = random_tree(rng, words, tags)
        c_tags = [t if rng.random() < 0.8 else "Q" for t in tags]
        c_words = [{"a": "b"}.get(w, w) if rng.random() < 0.9 else "z" for w in words]
        c = random_tree(rng, words, c_tags)
        gold += rows_of(s, g, words)
        parsed = s % 5 > 0
        if parsed:
            other += rows_of(s, c, c_words)
        below_root = {k[1] for k in g[1] if isinstance(k[1], int)} if "ROOT_P" in more else set()
        stay = [p for p in range(1, n + 1) if tags[p - 1] not in ("X", ",") and words[p - 1] != "gone" and p not in below_root]
        how = (stay, "LABELED" not in more, "DISC" in more)
        x, y = bag(g, *how), bag(c, *how) if parsed else Counter()
        same_words = parsed and all(a == b or {a, b} == {"a", "b"} for a, b in zip(words, c_words, strict=True))
        right = sum(parsed and tags[p - 1] == c_tags[p - 1] for p in stay)
        want[s] = (sum(t != "," for t in tags), len(stay), parsed, same_words, (x & y).total(), x.total(), y.total(), parsed and x == y, right)
    params = evaluate.parameters(PARAMS + more)
    per = evaluate.by_sentence(spark.createDataFrame(gold, NODES), spark.createDataFrame(other, NODES), params).cache()
    fields = ("length", "words", "parsed", "same_words", "matching", "gold", "candidate", "exact", "tags_right")
    rows = per.collect()
    assert {r.sentno: tuple(r[f] for f in fields) for r in rows} == want and len(rows) == len(want)
    for scope, those in (("all", list(want.values())), ("cutoff", [w for w in want.values() if w[0] <= 4])):
        (t,) = evaluate.totals(per, params).where(f"scope = '{scope}'").collect()
        assert (t.sentences, t.matching, t.gold, t.candidate, t.exact) == (len(those), *(sum(w[i] for w in those) for i in (4, 5, 6, 7)))


def test_parameter_files():
    p = evaluate.parameters(PARAMS)
    assert p["EQ_LABEL"] == {"S": "S", "T": "S", "U": "S"} and p["CUTOFF_LEN"] == 4 and p["LABELED"] == 1
    for bad in ("NO_SUCH 1", "EQ_LABEL A", "LABELED 1\nLABELED 0"):
        with pytest.raises(ValueError):
            evaluate.parameters(bad)


def test_words_of_one_side(spark):
    g = spark.createDataFrame([(1, 0, "A"), (1, 1, "B")], "sentno long, pos int, tag string")
    c = spark.createDataFrame([(1, 0, "A"), (1, 2, "B")], "sentno long, pos int, tag string")
    (r,) = evaluate.tag_accuracy(g, c).collect()
    assert (r.n, r.right) == (3, 1)


def test_no_trees(spark):
    none = spark.createDataFrame([], NODES)
    assert evaluate.by_sentence(none, none, evaluate.parameters("")).count() == 0


def test_sentences_meet_once(spark, monkeypatch):
    """Gold and candidate meet in one shuffle, by sentence; nothing is joined or written on the way. Labels that are not known are removed."""
    monkeypatch.setattr("dendrium.operators.staging.staged", None)
    trees = [("ROOT", (("S", (("N", 1), ("V", 3))), ("V", 2))), ("ROOT", (("N", 1), (None, (("V", 2),))))]
    nodes = spark.createDataFrame([r for s, t in enumerate(trees) for r in rows_of(s, t, "abc")], NODES)
    found = evaluate.by_sentence(nodes, nodes.where("sentno = 0 or label != 'N' or label is null"), evaluate.parameters(PARAMS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    got = {r.sentno: (r.matching, r.gold, r.candidate, r.exact, r.same_words, r.tags_right) for r in found.collect()}
    assert got == {0: (2, 2, 2, True, True, 3), 1: (0, 1, 1, False, False, 1)}


def test_totals_write_nothing(spark, monkeypatch):
    """eval_parameters goes through the trees once: no table is written before its totals."""
    monkeypatch.setattr(DataFrameWriter, "parquet", None)
    (everything, cutoff) = queries.QUERIES["eval_parameters"](spark, "/root/testdata/sf0.001").orderBy("scope").collect()
    assert everything.sentences == 1473 > cutoff.sentences > 0
