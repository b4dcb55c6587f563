"""Parsing against brute-force enumeration of all trees."""

import math
import random
from collections import defaultdict

import pytest

from dendrium.functions import parsing as P
from dendrium.functions import treetools as T
from dendrium.sources import formats as Fm


def grammar_of(texts, root):
    counts = defaultdict(int)
    for text in texts:
        t, w = Fm.parse_discbracket(text)
        for p in T.productions(T.add_fanout(T.binarize(t)), w):
            counts[p] += 1
    return P.Grammar.from_counts([(*p, n) for p, n in counts.items()], root)


RIGHT = "(S (RIGHT (X (A 0=a) (C 2=c)) (B 1=b) (X (D 3=d) (E 4=e))))"
WRONG = ["(S (WRONG (X (A 0=a) (B 1=b)) (C 2=c) (X (Z (D 3=e) (E 4=e)))))", "(S (WRONG2 (X (A 0=a) (B 1=b)) (C 2=c) (X (Z (D 3=e) (E 4=f)))))"]


def test_discontinuous_parse_recovers_the_tree():
    g = grammar_of([*WRONG, RIGHT, RIGHT, RIGHT], "S")
    chart = P.parse(list("abcde"), g)
    got = T.unbinarize(T.remove_fanout(P.derivation(chart)))
    assert got == Fm.parse_discbracket(RIGHT)[0]


AMBIGUOUS = P.Grammar(
    binary=[("S", "S", "S", "01", -math.log(0.4)), ("S", "A", "S", "01", -math.log(0.1)), ("A", "S", "S", "01", -math.log(0.3))],
    lexicon={"a": [("S", -math.log(0.5)), ("A", -math.log(0.7))], "b": [("S", -math.log(0.25))]}, root="S",
)


def every_tree(words, label, g):
    """All (cost, tree) of a continuous span."""

    def go(lo, hi, x):
        out = []
        if hi - lo == 1:
            out += [(c, T.Tree(x, (lo,))) for t, c in g.lexicon.get(words[lo], []) if t == x]
        for lhs, a, b, _, c in g.binary:
            if lhs == x:
                for m in range(lo + 1, hi):
                    out += [(c + p + q, T.Tree(x, (s, t))) for p, s in go(lo, m, a) for q, t in go(m, hi, b)]
        return out

    return go(0, len(words), label)


@pytest.mark.parametrize("sentence", ["ab", "aab", "abab", "aabba"])
def test_k_best_and_sums(sentence):
    words = list(sentence)
    want = sorted(every_tree(words, "S", AMBIGUOUS), key=lambda x: x[0])
    chart = P.parse(words, AMBIGUOUS)
    assert abs(chart.best[chart.goal][0] - want[0][0]) < 1e-9
    got = P.k_best(chart, len(want) + 5)
    assert len(got) == len(want) and all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert {str(t) for _, t in got} == {str(t) for _, t in want}
    total = sum(math.exp(-c) for c, _ in want)
    assert abs(P.inside(chart)[chart.goal] - total) < 1e-12
    share = defaultdict(float)
    for c, t in want:
        for x in {(n.label, frozenset(n.leaves())) for n in t.nodes()}:
            share[x] += math.exp(-c) / total
    post = P.posteriors(chart)
    assert post.keys() == share.keys() and all(abs(post[k] - share[k]) < 1e-9 for k in post)
    assert P.pruned(chart, k=1) == {(n.label, frozenset(n.leaves())) for n in got[0][1].nodes()}
    assert all(abs(P.tree_cost(t, words, AMBIGUOUS) - c) < 1e-9 for c, t in want)


def test_pruning_keeps_the_best():
    words = list("aabba")
    chart = P.parse(words, AMBIGUOUS)
    ok = P.pruned(chart, threshold=0.0)
    again = P.parse(words, AMBIGUOUS, allowed=lambda label, span: (label, span) in ok)
    assert abs(again.best[again.goal][0] - chart.best[chart.goal][0]) < 1e-12


def test_no_parse_and_unknown_words():
    chart = P.parse(["z", "a"], AMBIGUOUS)
    assert not chart.parsed() and P.derivation(chart) is None
    assert str(P.partial_parse(chart)) == "(NOPARSE (NOPARSE 0) (A 1))" and str(P.default_parse(["z"])) == "(NOPARSE (X 0))"


def test_concatenation():
    f = frozenset
    assert P.concatenates(f([0, 1]), f([2]), "01") and not P.concatenates(f([2]), f([0, 1]), "01")
    assert P.concatenates(f([0, 2]), f([1]), "010") and P.concatenates(f([0, 5]), f([1, 6]), "01,01") and not P.concatenates(f([0]), f([0]), "01")
    assert P.concatenates(f(range(0, 90)), f(range(90, 200)), "01")


def test_long_and_distributed(spark):
    sents = spark.createDataFrame([(1, list("abab")), (2, ["z"]), (3, ["a"])], "sent long, words array<string>")
    rows = {(r.sent, r["rank"]): r for r in P.parse_all(sents, AMBIGUOUS, k=3).collect()}
    assert set(rows) == {(1, 1), (1, 2), (1, 3), (2, 0), (3, 1)} and rows[(2, 0)].cost is None
    assert rows[(1, 1)].cost <= rows[(1, 2)].cost <= rows[(1, 3)].cost


def test_generation():
    rng = random.Random(1)
    g = P.Grammar(binary=[("S", "A", "B", "01", 0.0)], lexicon={"x": [("A", 0.0)], "y": [("B", math.log(2))], "z": [("B", math.log(2))]}, root="S")
    assert {tuple(P.generate(g, rng)) for _ in range(50)} == {("x", "y"), ("x", "z")}
