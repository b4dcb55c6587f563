"""Grammars of whole fragments against brute force on trees of any shape."""

from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import DataFrameWriter
from test_fragments import below, brute_recurring, occurs, random_trees, table, tree

from dendrium.operators import dop
from dendrium.plans import queries


def up_to(node, depth):
    """All fragments of a node of up to `depth` levels, as written."""
    if isinstance(node[1][0], str):
        return [f"({node[0]} {node[1][0]})"]
    options = [[f"({k[0]} )", *(up_to(k, depth - 1) if depth > 1 else [])] for k in node[1]]
    return [f"({node[0]} {' '.join(x)})" for x in product(*options)]


def leaves(node):
    if not node[1]:
        return [node[0]]
    if isinstance(node[1][0], str):
        return [f"{node[0]}@{node[1][0]}"]
    return [x for k in node[1] for x in leaves(k)]


def wanted(trees, occurrences):
    """{frag: (root, n, u)} from a list of fragments with repetitions for each tree."""
    n, u = Counter(), Counter()
    for here in occurrences:
        n.update(here)
        for f in here:
            u[f] += 1 / len(here)
    return {f: (tree(f)[0], n[f], u[f]) for f in n}


def check(nodes, trees, counted, want):
    got = {r.frag: (r.root, r.n, r.u) for r in counted.collect()}
    assert got.keys() == want.keys() and all(got[f][:2] == w[:2] and abs(got[f][2] - w[2]) < 1e-9 for f, w in want.items())
    flat = dop.flattened(counted)
    rules = dop.rules(flat, nodes)
    rows = rules.collect()
    assert Counter((r.frag, r.n) for r in dop.restored(rules, dop.dictionary(flat)).collect()) == {(f, w[1]): 1 for f, w in want.items()}
    # Rules from a root lead to the fragment's leaves, and to no other's.
    by = defaultdict(list)
    for r in rows:
        by[r.lhs].append(r)
    assert len({(r.lhs, tuple(r.rhs), r.word) for r in rows}) == len(rows)
    seen = Counter(n[0] for t in trees for n in below(t))
    ids = {r.frag: r.id for r in flat.collect()}
    mass = Counter()
    for root, n, _ in want.values():
        mass[root] += n
    for f, (root, n, u) in want.items():
        t = tree(f)
        if isinstance(t[1][0], str):
            (top,) = [r for r in by[root] if r.word == t[1][0]]
        else:
            (top,) = [r for r in by[root] if f"}}<{ids[f]}:" in r.rhs[0]]
            expand = lambda x: [z for y in by[x][0].rhs for z in expand(y)] if "}<" in x else [x]
            assert [z for y in top.rhs for z in expand(y)] == leaves(t) and all(len(by[x]) == 1 for x in top.rhs if "}<" in x)
        assert top.n == n and abs(top.rel - n / mass[root]) < 1e-12 and abs(top.bon - 2.0 ** -(f.count("(") - 1) * n / seen[root]) < 1e-12 and top.shortest == 0.5
    for weight in ("rel", "ewe"):
        assert all(abs(sum(r[weight] for r in rs) - 1) < 1e-9 for rs in by.values())
    assert all(r.word == r.lhs.split("@")[1] for r in rows if "@" in r.lhs)


@pytest.mark.parametrize("seed", [1, 2])
def test_double_dop(spark, seed):
    trees = random_trees(9, seed)
    nodes = table(spark, trees)
    frags = set(brute_recurring(trees)) | {f for t in trees for node in below(t) for f in up_to(node, 1)}
    want = wanted(trees, [[f for f in frags for node in below(t) if occurs(tree(f), node)] for t in trees])
    check(nodes, trees, dop.double_dop(nodes), want)


@pytest.mark.parametrize("depth", [1, 3])
def test_dop1(spark, depth):
    trees = random_trees(8, 5)
    nodes = table(spark, trees)
    check(nodes, trees, dop.dop1(nodes, depth), wanted(trees, [[f for node in below(t) for f in up_to(node, depth)] for t in trees]))


def test_no_trees(spark):
    nodes = table(spark, [])
    for counted in (dop.double_dop(nodes), dop.dop1(nodes, 2)):
        flat = dop.flattened(counted)
        assert dop.restored(dop.rules(flat, nodes), dop.dictionary(flat)).count() == 0


def test_subtrees_are_cut_at_the_depth(spark):
    """What is written for fragments of a depth are the different subtrees down to it, not the nodes: trees that differ below it only are the same."""
    deep = lambda k: ("S", (("A", (("B", (("C", (f"w{k}",)), ("C", ("x",)))), ("D", ("y",)))), ("E", ("z",))))
    trees = [deep(k) for k in range(50)]
    nodes = table(spark, trees)
    counted, seen = dop.dop1_seen(nodes, 2)
    check(nodes, trees, counted, wanted(trees, [[f for node in below(t) for f in up_to(node, 2)] for t in trees]))
    assert {r.label: r.seen for r in seen.collect()} == Counter(n[0] for t in trees for n in below(t))
    plan = dop.rules(dop.flattened(counted), nodes, seen)._jdf.queryExecution().optimizedPlan().toString()
    assert "sentno" not in plan


def test_rules_write_no_nodes(spark, monkeypatch):
    """dop_one: what is written has no node of a sentence, and less rows than there are nodes."""
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: written.append(self._df.columns) or write(self, path, *a, **b))
    assert queries.QUERIES["dop_one"](spark, "/root/testdata/sf0.001").count() > 0
    assert written and not any({"sentno", "nid"} & {*columns} for columns in written)
