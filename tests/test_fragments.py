"""Fragment queries and mining against brute force on trees of any shape."""

import math
import random
from collections import Counter
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from dendrium.operators import fragments, grammar

NODES = "corpus string, sentno long, nid long, parent long, side int, depth int, label string, prod string"


def tree(text):
    """A bracketed tree as (label, children)."""
    return fragments.parsed(text)


def rows_of(trees, corpus="c"):
    out = []
    for sentno, t in enumerate(trees):
        count = 0

        def walk(node, parent, side, depth, sentno=sentno):
            nonlocal count
            nid, count = count, count + 1
            label, kids = node
            word = isinstance(kids[0], str)
            out.append((corpus, sentno, nid, parent, side, depth, label, f"{label} ={kids[0]}" if word else " ".join([label, *(k[0] for k in kids)])))
            for i, k in enumerate(kids, 1):
                if not word:
                    walk(k, nid, i, depth + 1)

        walk(t, None, None, 0)
    return out


def prod(node):
    label, kids = node
    return (label, kids[0]) if isinstance(kids[0], str) else (label, *[(k[0],) for k in kids])


def below(node):
    yield node
    for k in node[1]:
        if not isinstance(k, str) and k[1]:
            yield from below(k)


def common(x, y):
    """The largest fragment that two matching nodes share."""
    if isinstance(x[1][0], str):
        return f"({x[0]} {x[1][0]})"
    return f"({x[0]} " + " ".join(common(a, b) if prod(a) == prod(b) else f"({a[0]} )" for a, b in zip(x[1], y[1], strict=True)) + ")"


def tops(x, y):
    """Pairs of matching nodes whose parents do not match in the same slot."""

    def parents(t):
        found = {id(t): None}
        for n in below(t):
            for i, k in enumerate(n[1]):
                if not isinstance(k, str):
                    found[id(k)] = (prod(n), i)
        return found

    up_x, up_y = parents(x), parents(y)
    for a, b in product(below(x), below(y)):
        if prod(a) == prod(b) and (up_x[id(a)] is None or up_x[id(a)] != up_y[id(b)]):
            yield a, b


def occurs(frag, node):
    if prod(frag) != prod(node):
        return False
    return isinstance(frag[1][0], str) or all(not f[1] or occurs(f, k) for f, k in zip(frag[1], node[1], strict=True))


def brute_recurring(one, other=None, count_in=None):
    pairs = combinations(one, 2) if other is None else product(one, other)
    found = {common(a, b) for x, y in pairs for a, b in tops(x, y)}
    within = count_in if count_in is not None else one
    n = {f: sum(occurs(tree(f), node) for t in within for node in below(t)) for f in found}
    return {f: k for f, k in n.items() if k}


def random_trees(n, seed, depth=4):
    rng = random.Random(seed)

    def make(d):
        if d == 0 or rng.random() < 0.25:
            return (rng.choice("AB"), (rng.choice("xyz"),))
        return (rng.choice("ST"), tuple(make(d - 1) for _ in range(rng.choice([1, 2, 2, 3]))))

    return [make(depth) for _ in range(n)]


# Fixed values, with the results of the published tool on them: seven sentences, 25 recurring fragments, 100 occurrences.
CATS = """(S (NP (DT The) (NN cat)) (VP (VBP saw) (NP (DT the) (NP|<JJ,NN> (JJ hungry) (NN dog)))))
(S (NP (DT The) (NN cat)) (VP (VBP saw) (NP (DT the) (NN dog))))
(S (NP (DT The) (NN mouse)) (VP (VBP saw) (NP (DT the) (NN cat))))
(S (NP (DT The) (NN mouse)) (VP (VBP saw) (NP (DT the) (NP|<JJ,NN> (JJ yellow) (NN cat)))))
(S (NP (DT The) (NP|<JJ,NN> (JJ little) (NN mouse))) (VP (VBP saw) (NP (DT the) (NN cat))))
(S (NP (DT The) (NN cat)) (VP (VBP ate) (NP (DT the) (NN dog))))
(S (NP (DT The) (NN mouse)) (VP (VBP ate) (NP (DT the) (NN cat))))""".splitlines()


def table(spark, trees, corpus="c"):
    return spark.createDataFrame(rows_of(trees, corpus), NODES)


def collected(df):
    rows = df.collect()
    assert all(r.frag.startswith(f"({r.root} ") for r in rows)
    return {r.frag: r.n for r in rows}


def test_recurring_of_the_fixed_sentences(spark):
    got = collected(fragments.recurring(table(spark, [tree(t) for t in CATS])))
    assert (len(got), sum(got.values())) == (25, 100)
    assert got == brute_recurring([tree(t) for t in CATS])


@pytest.mark.parametrize("seed", [1, 2])
def test_recurring(spark, seed):
    trees = random_trees(12, seed)
    trees += [trees[0], trees[3], tree("(A x)")]
    assert collected(fragments.recurring(table(spark, trees))) == brute_recurring(trees)


def test_recurring_in_two_treebanks(spark):
    one, two = random_trees(8, 3), random_trees(7, 4)
    a, b = table(spark, one, "a"), table(spark, two, "b")
    assert collected(fragments.recurring(a, b)) == brute_recurring(one, two)
    assert collected(fragments.recurring(a, b, count_in=b)) == brute_recurring(one, two, two)


def test_no_trees_or_nothing_in_common(spark):
    assert fragments.recurring(table(spark, [])).count() == 0
    assert fragments.recurring(table(spark, random_trees(1, 5))).count() == 0
    assert fragments.recurring(table(spark, [tree("(A x)"), tree("(B x)")])).count() == 0


def test_search(spark):
    trees = random_trees(40, 6)
    batch = {"one": "(S (T ) (A ))", "word": "(A x)", "deep": "(S (T (A ) (B )) (S ))", "both": "(T (A x) (B y))", "three": "(S (A ) (S (T ) (T )) (B z))", "unary": "(S (S (A )))", "never": "(Q (A ))"}
    batch |= {f"m{i}": f for i, f in enumerate(sorted(brute_recurring(trees[:10])))}
    nodes = table(spark, trees)
    found = fragments.search(nodes, batch)
    want = Counter({(f, s, i): 1 for f, text in batch.items() for s, t in enumerate(trees) for i, node in enumerate(below(t)) if occurs(tree(text), node)})
    assert Counter((r.frag, r.sentno, r.nid) for r in found.collect()) == want
    n = {r.frag: r.n for r in fragments.counts(found, batch).collect()}
    assert n == {f: sum(k[0] == f for k in want) for f in batch}
    have = {(r.frag, r.sentno) for r in fragments.candidates(nodes, {k: batch[k] for k in ("deep", "both", "never")}).collect()}
    assert {(f, s) for f, s, _ in want if f in ("deep", "both", "never")} <= have and not any(f == "never" for f, _ in have)


@pytest.mark.parametrize("bad", ["", "(A", "A", "(A )", "(A x) y", "(A x y)", "(A (B ) x)", "()", "(A ))"])
def test_what_is_no_fragment(bad):
    with pytest.raises(ValueError):
        fragments.parsed(bad)


def test_weights(spark):
    trees = random_trees(9, 7)
    got = {r.frag: (r.root, r.w) for r in fragments.ewe(table(spark, trees)).collect()}
    frags = brute_recurring(trees)
    u = Counter()
    for t in trees:
        here = [f for f in frags for node in below(t) if occurs(tree(f), node)]
        for f in here:
            u[f] += 1 / len(here)
    total = Counter()
    for f, x in u.items():
        total[tree(f)[0]] += x
    assert set(got) == set(u) and all(got[f][0] == tree(f)[0] and abs(got[f][1] - x / total[tree(f)[0]]) < 1e-12 for f, x in u.items())


def test_kernel(spark):
    trees = random_trees(6, 8)
    trees += [trees[0], trees[0]]
    copies = Counter(trees)
    got = sorted(r.n for r in fragments.kernel(table(spark, trees)).collect())
    same = lambda x, y: sum(prod(a) == prod(b) for a, b in product(below(x), below(y)))
    pairs = [*combinations(copies, 2), *((t, t) for t, k in copies.items() if k > 1)]
    assert got == sorted(n for x, y in pairs if (n := same(x, y)))


def test_kernel_moves_no_pairs(spark, monkeypatch):
    """Pairs are summed up where they meet, in as many tasks as the meetings ask for; productions share bits, numbers of nodes say nothing."""
    monkeypatch.setattr(fragments, "CELL", 500)
    rng = random.Random(5)
    trees = [("S", tuple((f"L{rng.randrange(200)}", ("x",)) for _ in range(rng.randrange(1, 30)))) for _ in range(40)]
    trees += [trees[3], trees[7]]
    rows = [(("b", "a", "c")[s % 3], *r[1:]) for s, t in enumerate(trees) for r in ((x[0], s, *x[2:]) for x in rows_of([t]))]
    rows = [(c, s, nid + 100 * (s > 39), None if parent is None else parent + 100 * (s > 39), *rest) for c, s, nid, parent, *rest in rows]
    rows += [(None, 99, *r[2:]) for r in rows_of([trees[5]])]
    first, copies = {}, Counter([*trees, trees[5]])
    for s, t in enumerate(trees):
        first[t] = min(first.get(t, ("d", 0)), (("b", "a", "c")[s % 3], s))
    found = fragments.kernel(spark.createDataFrame(rows, NODES))
    bags = {first[t]: Counter(prod(x) for x in below(t)) for t in first}
    same = {(*x, *y): sum(n * bags[y][p] for p, n in bags[x].items()) for x in bags for y in bags if x < y}
    same |= {(*first[t], *first[t]): sum(n * n for n in bags[first[t]].values()) for t, k in copies.items() if k > 1}
    assert {(r.a_corpus, r.a, r.b_corpus, r.b): r.n for r in found.collect()} == {k: n for k, n in same.items() if n}
    assert found.count() == sum(n > 0 for n in same.values())
    assert found.rdd.getNumPartitions() > 2 and "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    few = fragments.kernel(spark.createDataFrame(rows, NODES), least=3)
    assert few.count() == sum(n > 2 for n in same.values())
    assert fragments.kernel(table(spark, [])).count() == 0


@pytest.mark.parametrize("meet", [1, 40, 100_000])
def test_kernel_in_batches(spark, monkeypatch, meet):
    """A tree is one row where trees meet; pairs are summed up in batches of any size, none in a table of pairs."""
    monkeypatch.setattr(fragments, "MEET", meet)
    monkeypatch.setattr(fragments, "POSTINGS", 90)
    rng = random.Random(meet)
    trees = [("S", tuple((f"L{rng.randrange(9)}", ("x",)) for _ in range(rng.randrange(1, 12)))) for _ in range(25)]
    trees += trees[:3]
    found = fragments.kernel(table(spark, trees))
    first = {}
    for s, t in enumerate(trees):
        first.setdefault(t, s)
    bags, copies = {s: Counter(prod(x) for x in below(t)) for t, s in first.items()}, Counter(trees)
    want = {(a, b): sum(n * bags[b][p] for p, n in bags[a].items()) for a in bags for b in bags if a < b}
    want |= {(s, s): sum(n * n for n in bags[s].values()) for t, s in first.items() if copies[t] > 1}
    assert {(r.a, r.b): r.n for r in found.collect()} == {k: n for k, n in want.items() if n}
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_written_fragments(spark):
    df = spark.createDataFrame([("(S (NP (DT The) (NN )) (VP ))",), ("(A x)",), ("(A )",)], "f string")
    assert [tuple(r) for r in df.select(fragments.n_words(F.col("f")), fragments.n_open(F.col("f"))).collect()] == [(1, 2), (1, 0), (0, 1)]


def all_fragments(node):
    """How many fragments start at a node."""
    out = 1
    for k in node[1]:
        if not isinstance(k, str):
            out *= all_fragments(k) + 1
    return out


def test_reduction_weights(spark):
    trees = random_trees(10, 11)
    nodes = table(spark, trees)
    count = {(s, i): all_fragments(node) for s, t in enumerate(trees) for i, node in enumerate(below(t))}
    got = grammar.log_subtrees(nodes).collect()
    assert {(r.sentno, r.nid) for r in got} == set(count) and all(abs(math.exp(r.la) / count[r.sentno, r.nid] - 1) < 1e-9 for r in got)
    for estimate in ("relative", "equal"):
        rules = grammar.dop_weights(nodes, estimate).collect()
        sums = Counter()
        for r in rules:
            sums[r.lhs] += r.w
        assert len(sums) == len(count) + len({n[0] for t in trees for n in below(t)}) and all(abs(x - 1) < 1e-9 for x in sums.values())
    mass = Counter()
    for s, t in enumerate(trees):
        for i, node in enumerate(below(t)):
            mass[node[0]] += count[s, i]
    plain = {(r.lhs, r.rhs): r.w for r in grammar.dop_weights(nodes).collect() if "@" not in r.lhs + r.rhs}
    want = Counter()
    for t in trees:
        for node in below(t):
            want[node[0], f"={node[1][0]}" if isinstance(node[1][0], str) else " ".join(k[0] for k in node[1])] += 1 / mass[node[0]]
    assert set(plain) == set(want) and all(abs(plain[k] - want[k]) < 1e-12 for k in want)
    assert {r.w for r in grammar.dop_weights(nodes, "shortest").collect()} == {0.5, 1.0}
    assert grammar.dop_weights(table(spark, [])).count() == 0
