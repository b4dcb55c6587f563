"""Mining of chains (trees in which one child of a node has a row) against brute force, and that they are not paired."""

import random
from collections import Counter
from itertools import combinations, product

import pytest

from dendrium.operators import dop, fragments

NODES = "corpus string, sentno long, nid long, parent long, side int, depth int, label string, prod string"


def random_chains(n, seed):
    """Chains as lists of (label, labels of the two children, slot of the one that goes on), from the root."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        depth = rng.choice([1, 2, 3, 5, 6])
        label, chain = rng.choice("ST"), []
        for d in range(depth):
            kids, slot = [rng.choice("AB"), rng.choice("AB")], rng.choice([1, 1, 2])
            if d + 1 < depth:
                kids[slot - 1] = rng.choice("STA")  # A stands for a node or for an open one
            chain.append((label, tuple(kids), slot if d + 1 < depth else None))
            label = kids[slot - 1]
        out.append(chain)
    return out


def table(spark, chains, corpus="c"):
    rows = [(corpus, s, d, d - 1 if d else None, c[d - 1][2] if d else None, d, label, " ".join([label, *kids])) for s, c in enumerate(chains) for d, (label, kids, _) in enumerate(c)]
    return spark.createDataFrame(rows, NODES)


def written(chain):
    (label, kids, slot), rest = chain[0], chain[1:]
    return f"({label} " + " ".join(written(rest) if rest and i == slot else f"({k} )" for i, k in enumerate(kids, 1)) + ")"


def common(x, y):
    """What two chains begin with."""
    k = 1
    while k < min(len(x), len(y)) and x[k - 1][2] == y[k - 1][2] and x[k][:2] == y[k][:2]:
        k += 1
    return written(x[:k])


def begins(c):
    return {written(c[:k]) for k in range(1, len(c) + 1)}


def brute(one, other=None, count_in=None):
    found = set()
    for x, y in combinations(one, 2) if other is None else product(one, other):
        for i, j in product(range(len(x)), range(len(y))):
            if x[i][:2] == y[j][:2] and not (i and j and x[i - 1] == y[j - 1]):
                found.add(common(x[i:], y[j:]))
    n = Counter(f for c in (one if count_in is None else count_in) for i in range(len(c)) for f in begins(c[i:]) if f in found)
    return dict(n)


def collected(df):
    return {r.frag: r.n for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_chains(spark, seed):
    chains = random_chains(40, seed)
    chains += [chains[0], chains[5]]
    assert collected(fragments.recurring(table(spark, chains))) == brute(chains)


def test_chains_of_two_treebanks(spark):
    one, two, third = random_chains(15, 3), random_chains(20, 4), random_chains(20, 5)
    a, b, c = table(spark, one, "a"), table(spark, two, "b"), table(spark, third, "c")
    assert collected(fragments.recurring(a, b)) == brute(one, two)
    assert collected(fragments.recurring(a, b, count_in=b)) == brute(one, two, two)
    assert collected(fragments.recurring(a, b, count_in=c)) == brute(one, two, third)


def test_chains_are_not_paired(spark):
    classed = fragments.classes(table(spark, random_chains(40, 6)))
    assert fragments.matching(classed).count() == 0


def test_double_dop_of_chains(spark):
    chains = random_chains(30, 7)
    found = set(brute(chains)) | {written(c[i : i + 1]) for c in chains for i in range(len(c))}
    n = Counter(f for c in chains for i in range(len(c)) for f in begins(c[i:]) if f in found)
    assert {r.frag: r.n for r in dop.double_dop(table(spark, chains)).collect()} == dict(n)
