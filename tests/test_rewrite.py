"""Rewriting of trees, against brute force on random discontinuous trees and on trees with known results."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from dendrium.operators import heads, rewrite
from dendrium.plans import queries

SCHEMA = "corpus string, sentno long, nid int, parent int, side int, depth int, label string, pos int, word string"


def rows(tree, sentno, corpus="c"):
    """Node rows of (label, [children]), (label, pos, word) being a node over a word; also {nid: tree}."""
    out, by = [], {}

    def first(t):
        return t[1] if len(t) == 3 else min(map(first, t[1]))

    def walk(t, parent, side, depth):
        nid = len(out)
        by[nid] = t
        out.append((corpus, sentno, nid, parent, side, depth, t[0], *(t[1:] if len(t) == 3 else (None, None))))
        if len(t) == 2:
            for i, k in enumerate(sorted(t[1], key=first), 1):
                walk(k, nid, i, depth + 1)

    walk(tree, None, None, 0)
    return out, by


def shown(df, sentno):
    """The rows of one sentence as text, children by side; words with their numbers."""
    all_rows = [r for r in df.where(f"sentno = {sentno}").collect()]
    kids = {}
    for r in all_rows:
        kids.setdefault(r.parent, []).append(r)

    def text(r):
        below = sorted(kids.get(r.nid, []), key=lambda k: k.side)
        assert [k.side for k in below] == list(range(1, len(below) + 1)) and all(k.depth == r.depth + 1 for k in below)
        return f"({r.label} {r.pos}={r.word})" if r.pos is not None else f"({r.label} {' '.join(map(text, below))})"

    return " ".join(text(r) for r in kids.get(None, []))


def spelled(tree):
    def first(t):
        return t[1] if len(t) == 3 else min(map(first, t[1]))

    return f"({tree[0]} {tree[1]}={tree[2]})" if len(tree) == 3 else f"({tree[0]} {' '.join(spelled(k) for k in sorted(tree[1], key=first))})"


def grown(rng, places, depth=0):
    """A random tree over the places, phrases often discontinuous."""
    if len(places) == 1 and (depth > 0 or rng.random() < 0.5):
        return ("T", places[0], rng.choice(["a", "b", ",", "."]))
    places = places[:]
    rng.shuffle(places)
    n = rng.randint(1, min(3, len(places))) if depth < 4 else len(places)
    parts = [[p] for p in places[:n]]
    for p in places[n:]:
        rng.choice(parts).append(p)
    if n == 1 and len(places) > 1 and depth > 2:
        parts = [[p] for p in places]
    return (rng.choice("SXY"), [grown(rng, sorted(p), depth + 1) for p in parts])


def word_places(t):
    return [t[1]] if len(t) == 3 else [p for k in t[1] for p in word_places(k)]


def raised_by_hand(tree, head_of):
    """Children in other runs than the head's are handed upwards, from the bottom. Returns the tree and what it hands on."""

    def own_run(t):
        places, at = set(word_places(t)), head_of(t)
        lo = hi = at
        while lo - 1 in places:
            lo -= 1
        while hi + 1 in places:
            hi += 1
        return lo, hi

    def walk(t):
        if len(t) == 3:
            return t, []
        lo, hi = own_run(t)
        stay, go = [], []
        for k in t[1]:
            kid, loose = walk(k)
            for x, (a, b) in [(kid, own_run(k)), *loose]:
                (stay if lo <= a and b <= hi else go).append((x, (a, b)))
        return (t[0], [x for x, _ in stay]), go

    done, go = walk(tree)
    assert not go
    return done


def test_raised(spark):
    rng = random.Random(3)
    trees = {i: grown(rng, list(range(1, rng.randint(1, 9) + 1))) for i in range(60)}
    trees = {i: t if len(t) == 2 else ("S", [t]) for i, t in trees.items()}
    all_rows, all_heads, by_hand = [], [], {}
    for i, t in trees.items():
        new, by = rows(t, i)
        all_rows += new
        choice = {}
        for nid in by:
            below = [r[2] for r in new if r[3] == nid]
            if below:
                choice[nid] = rng.choice(below)
                all_heads.append(("c", i, nid, choice[nid]))

        def head_word(nid, choice=choice, by=by):
            return by[nid][1] if nid not in choice else head_word(choice[nid], choice, by)

        of = {id(x): head_word(nid) for nid, x in by.items()}
        by_hand[i] = spelled(raised_by_hand(t, lambda x, of=of: of[id(x)]))
    nodes = spark.createDataFrame(all_rows, SCHEMA)
    out = rewrite.raised(nodes, spark.createDataFrame(all_heads, "corpus string, sentno long, nid int, head int")).cache()
    assert {i: shown(out, i) for i in trees} == by_hand
    assert any(by_hand[i] != spelled(t) for i, t in trees.items())


def test_raised_needs_heads(spark):
    nodes = spark.createDataFrame(rows(("S", [("X", [("T", 1, "a"), ("T", 3, "b")]), ("T", 2, "c")]), 1)[0], SCHEMA)
    with pytest.raises(ValueError, match="lexical head"):
        rewrite.raised(nodes, spark.createDataFrame([], "corpus string, sentno long, nid int, head int"))


def moved_by_hand(tree):
    """One mark after the other, the last first, each beside the highest node that begins right behind it."""
    label, kids = tree
    kids = list(kids)
    mutable = [label, kids]

    def open_up(t):
        return t if len(t) == 3 else [t[0], [open_up(k) for k in t[1]]]

    mutable = open_up(tree)
    marks = sorted((k for k in mutable[1] if len(k) == 3 and k[2] in ",."), key=lambda k: k[1])
    while marks:
        m = marks.pop()
        if len(mutable[1]) == 1:
            continue
        mutable[1].remove(m)
        queue, dest = [mutable], mutable
        while queue:
            t = queue.pop(0)
            if len(t) == 3:
                continue
            if any(min(word_places(k)) == m[1] + 1 for k in t[1]):
                dest = t
                break
            queue += t[1]
        dest[1].append(m)
    return mutable


def test_punctuation_moves(spark):
    rng = random.Random(8)
    trees = {}
    for i in range(60):
        n = rng.randint(2, 9)
        marks = [p for p in range(1, n + 1) if rng.random() < 0.35]
        rest = [p for p in range(1, n + 1) if p not in marks]
        inner = grown(rng, rest, 1) if rest else None
        top = [] if inner is None else [inner] if len(inner) == 3 or rng.random() < 0.5 else list(inner[1])
        trees[i] = ("S", top + [("T", p, rng.choice(",.")) for p in marks])
    nodes = spark.createDataFrame([r for i, t in trees.items() for r in rows(t, i)[0]], SCHEMA)
    moved = rewrite.punct_moved(nodes).cache()
    assert {i: shown(moved, i) for i in trees} == {i: spelled(moved_by_hand(t)) for i, t in trees.items()}

    def gone(t):
        if len(t) == 3:
            return None if t[2] in ",." else t
        kids = [k for k in map(gone, t[1]) if k]
        return (t[0], kids) if kids else None

    def counted(t):
        order = {p: i for i, p in enumerate(sorted(word_places(t)), 1)}
        again = lambda t: (t[0], order[t[1]], t[2]) if len(t) == 3 else (t[0], [again(k) for k in t[1]])
        return again(t)

    left = rewrite.punct_removed(moved).cache()
    assert {i: shown(left, i) for i in trees} == {i: spelled(counted(gone(t))) if gone(t) else "" for i, t in trees.items()}

    def flat(t):
        marks = []

        def strip(t):
            if len(t) == 3:
                if t[2] in ",.":
                    marks.append(t)
                    return None
                return t
            kids = [k for k in map(strip, t[1]) if k]
            return (t[0], kids) if kids else None

        top = strip(t) or (t[0], [])
        return (t[0], top[1] + marks)

    back = rewrite.punct_to_root(moved).cache()
    assert {i: shown(back, i) for i in trees} == {i: spelled(flat(t)) for i, t in trees.items()}


def test_prune_and_root_words(spark):
    t = ("S", [("T", 1, '"'), ("T", 2, "."), ("X", [("T", 3, "a"), ("T", 4, "."), ("T", 5, "b"), ("Y", [("T", 6, ".")])]), ("T", 7, "c"), ("T", 8, "''")])
    only = ("S", [("T", 1, "."), ("T", 2, '"')])
    nodes = spark.createDataFrame(rows(t, 1)[0] + rows(only, 2)[0] + rows(("T", 1, None), 3)[0], SCHEMA)
    out = rewrite.punct_pruned(nodes)
    assert shown(out, 1) == "(S (X (T 1=a) (T 2=.) (T 3=b) (Y (T 4=.))) (T 5=c))"
    assert shown(out, 2) == "" and shown(out, 3) == "(T 1=None)"
    assert shown(rewrite.root_words_removed(nodes), 1) == "(S (X (T 1=a) (T 2=.) (T 3=b) (Y (T 4=.))))"
    assert shown(rewrite.punct_to_root(nodes), 3) == "(T 1=None)"


def test_defined_results(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (rewrite.punct_moved, rewrite.punct_to_root, rewrite.punct_removed, rewrite.punct_pruned, rewrite.numbered):
        assert f(empty).count() == 0
    assert rewrite.raised(empty, spark.createDataFrame([], "corpus string, sentno long, nid int, head int")).count() == 0
    nodes = spark.createDataFrame([("c", 1, 0, 1, 1, 0, "S", None, None), ("c", 1, 1, 0, 1, 1, "X", None, None), ("c", 1, 2, 1, 1, 1, "T", 1, "a")], SCHEMA)
    with pytest.raises(ValueError, match="above itself"):
        rewrite.numbered(nodes)


def test_heads_by_rules_raise(spark):
    t = ("S", [("N", [("D", 1, "p"), ("R", [("K", 4, "q"), ("G", 6, "r"), ("G", 7, "o")])]), ("B", 2, "s"), ("M", [("J", 3, "t"), ("E", 5, "x")])])
    nodes = spark.createDataFrame(rows(t, 1)[0], SCHEMA)
    rules = "S left-to-right B\nN left-to-right D\nR right-to-left G\nM left-to-right J"
    out = rewrite.raised(nodes, heads.head_children(nodes, rules))
    assert shown(out, 1) == "(S (N (D 1=p)) (B 2=s) (M (J 3=t)) (K 4=q) (E 5=x) (R (G 6=r) (G 7=o)))"


def test_heads_found_on_the_way(spark):
    """raised_by() is raised() with the heads of head_children()."""
    rng = random.Random(4)
    trees = {i: grown(rng, list(range(1, rng.randint(2, 9) + 1))) for i in range(40)}
    nodes = spark.createDataFrame([r for i, t in trees.items() for r in rows(t if len(t) == 2 else ("S", [t]), i)[0]], SCHEMA)
    rules = "S left-to-right Y T\nS rightdis X Y\nX right-to-left S T\nY leftdis T X\nY left-to-right S"
    one, two = rewrite.raised_by(nodes, rules), rewrite.raised(nodes, heads.head_children(nodes, rules))
    assert one.count() > 0 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


@pytest.mark.parametrize("name", ["xf_punct_root", "xf_raise", "xf_punct_prune", "xf_punct_move", "xf_punct_remove"])
def test_trees_are_written_once(spark, monkeypatch, name):
    """Sentences meet once and are rewritten there: no table is written but the result, and nothing is joined by nodes."""
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: written.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, path, *a, **b))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(written) == 1
    (plan,) = written
    assert "nid" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "Join" in x)


def test_trees_without_corpus(spark):
    """As in SQL, a sentence is what has one number: without a corpus too. Sentences that span batches stay whole."""
    t = ("S", [("T", 1, ","), ("X", [("T", 2, "a"), ("T", 3, "b")])])
    nodes = spark.createDataFrame(rows(t, 1, None)[0] + rows(t, 1)[0], SCHEMA)
    assert {(r.corpus, r.nid, r.pos) for r in rewrite.punct_removed(nodes).collect()} == {(c, n, p) for c in (None, "c") for n, p in ((0, None), (2, None), (3, 1), (4, 2))}
    many = [r for i, n in enumerate((30_000, 3, 60_000, 1)) for r in [("c", i, 0, None, None, 0, "S", None, None), *(("c", i, k, 0, k, 1, "T", k, "," if k % 2 else "a") for k in range(1, n + 1))]]
    left = rewrite.punct_removed(spark.createDataFrame(many, SCHEMA))
    assert {r.sentno: (r.n, r.top) for r in left.groupBy("sentno").agg(F.count("pos").alias("n"), F.max("side").alias("top")).collect()} == {0: (15_000, 15_000), 1: (1, 1), 2: (30_000, 30_000)}
