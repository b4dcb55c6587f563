"""Weighted deduction over one sentence: charts, best and k-best derivations, inside and outside sums, pruning.

A grammar is a Grammar of binary and unary rules with costs -ln p and yield functions, and a lexicon. Spans are sets of
word positions, so the same agenda parses continuous and discontinuous grammars. parse_all() runs it in Arrow batches.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass, field

from dendrium.functions.treetools import Tree, ranges


@dataclass
class Grammar:
    """binary: (lhs, left, right, yf, cost); unary: (lhs, child, cost); lexicon: word -> [(tag, cost)]. yf is a string such as
    '01' or '0,10': which child each part of a span comes from."""

    binary: list = field(default_factory=list)
    unary: list = field(default_factory=list)
    lexicon: dict = field(default_factory=dict)
    root: str = "S"
    open_tags: tuple = ()

    def __post_init__(self):
        self.by_left, self.by_right, self.by_child = defaultdict(list), defaultdict(list), defaultdict(list)
        for r in self.binary:
            self.by_left[r[1]].append(r)
            self.by_right[r[2]].append(r)
        for r in self.unary:
            self.by_child[r[1]].append(r)

    @classmethod
    def from_counts(cls, rows, root: str) -> Grammar:
        """From (lhs, rhs tuple, yf, word, n): relative frequencies."""
        total = defaultdict(float)
        rows = list(rows)
        for lhs, _, _, _, n in rows:
            total[lhs] += n
        g = cls(root=root)
        for lhs, rhs, yf, word, n in rows:
            cost = -math.log(n / total[lhs])
            if word is not None:
                g.lexicon.setdefault(word, []).append((lhs, cost))
            elif len(rhs) == 1:
                g.unary.append((lhs, rhs[0], cost))
            elif len(rhs) == 2:
                g.binary.append((lhs, *rhs, yf, cost))
            else:
                raise ValueError("binarize the trees first")
        g.__post_init__()
        return g


def concatenates(left: frozenset, right: frozenset, yf: str) -> bool:
    """Whether two sets of positions combine as the yield function says: its parts are the runs of the union, and within a
    part the children's runs alternate as written."""
    if left & right:
        return False
    owner = {x: "0" for x in left} | {x: "1" for x in right}
    starts = {r[0] for s in (left, right) for r in ranges(s)}
    parts = []
    for run in ranges(owner):
        part = ""
        for x in run:
            if not part or part[-1] != owner[x] or x in starts:
                part += owner[x]
        parts.append(part)
    return ",".join(parts) == yf


@dataclass
class Chart:
    words: list
    goal: tuple
    edges: dict  # item -> [(cost of the rule, children items or word)]
    best: dict  # item -> (cost, edge)

    def parsed(self) -> bool:
        return self.goal in self.best


def parse(words: list[str], g: Grammar, tags: list[str] | None = None, allowed=None, exhaustive: bool = True, beta: float | None = None) -> Chart:
    """Agenda parsing, cheapest item first. An item is (label, positions). allowed(label, positions) prunes; without
    `exhaustive` parsing ends at the goal; with beta, items worse than the best with the same positions by more are dropped."""
    edges, best, agenda, cells = defaultdict(list), {}, [], {}
    order = 0
    goal = (g.root, frozenset(range(len(words))))
    by_label: dict[str, list] = defaultdict(list)

    def push(item, cost, edge):
        nonlocal order
        if allowed is not None and not allowed(*item):
            return
        edges[item].append(edge)
        if item not in done:
            order += 1
            heapq.heappush(agenda, (cost, order, item, edge))

    done: set = set()
    for i, w in enumerate(words):
        entries = g.lexicon.get(w) or g.lexicon.get(w.lower()) or [(t, -math.log(1e-3 / len(g.open_tags))) for t in g.open_tags]
        for tag, cost in entries:
            if tags is None or tag == tags[i] or tag.startswith(tags[i] + "@"):
                push((tag, frozenset([i])), cost, (cost, (), w))
    while agenda:
        cost, _, item, edge = heapq.heappop(agenda)
        if item in done:
            continue
        label, span = item
        if beta is not None and cost > cells.setdefault(span, cost) + beta:
            continue
        done.add(item)
        best[item] = (cost, edge)
        by_label[label].append(item)
        if item == goal and not exhaustive:
            break
        for lhs, _, c in g.by_child[label]:
            push((lhs, span), cost + c, (c, (item,), None))
        for lhs, _, right, yf, c in g.by_left[label]:
            for other in by_label[right]:
                if concatenates(span, other[1], yf):
                    push((lhs, span | other[1]), cost + best[other][0] + c, (c, (item, other), None))
        for lhs, left, _, yf, c in g.by_right[label]:
            for other in by_label[left]:
                if other != item and concatenates(other[1], span, yf):
                    push((lhs, other[1] | span), best[other][0] + cost + c, (c, (other, item), None))
    return Chart(words, goal, {k: list(dict.fromkeys(v)) for k, v in edges.items()}, best)


def derivation(chart: Chart, item=None) -> Tree | None:
    """The cheapest derivation as a tree."""
    item = item or chart.goal
    if item not in chart.best:
        return None
    _, (_, kids, _) = chart.best[item]
    return Tree(item[0], tuple(derivation(chart, k) for k in kids) if kids else (min(item[1]),))


def k_best(chart: Chart, k: int) -> list[tuple[float, Tree]]:
    """The k cheapest derivations: each item keeps its k best lazily, edges hold ranks of their children."""
    lists: dict = {}
    state: dict = {}

    def kth(item, n):
        have = lists.setdefault(item, [])
        if item not in state:
            state[item] = ([], set())
            for e in chart.edges.get(item, []):
                add(item, e, (0,) * len(e[1]))
        heap, _ = state[item]
        while len(have) <= n and heap:
            cost, _, edge, ranks = heapq.heappop(heap)
            have.append((cost, edge, ranks))
            for i in range(len(ranks)):
                add(item, edge, (*ranks[:i], ranks[i] + 1, *ranks[i + 1 :]))
        return have[n] if n < len(have) else None

    active: set = set()

    def add(item, edge, ranks):
        heap, seen = state[item]
        if (edge, ranks) in seen:
            return
        seen.add((edge, ranks))
        cost = edge[0]
        if item in active:  # a cycle of unary rules
            return
        active.add(item)
        for child, r in zip(edge[1], ranks, strict=True):
            one = kth(child, r)
            if one is None:
                active.discard(item)
                return
            cost += one[0]
        active.discard(item)
        heapq.heappush(heap, (cost, len(seen), edge, ranks))

    def tree(item, n):
        _, edge, ranks = lists[item][n]
        return Tree(item[0], tuple(tree(c, r) for c, r in zip(edge[1], ranks, strict=True)) if edge[1] else (min(item[1]),))

    out = []
    for n in range(k):
        one = kth(chart.goal, n)
        if one is None:
            break
        out.append((one[0], tree(chart.goal, n)))
    return out


def inside(chart: Chart) -> dict:
    """Probability mass of each item, for charts without unary cycles."""
    mass: dict = {}

    def go(item):
        if item not in mass:
            mass[item] = 0.0
            mass[item] = sum(math.exp(-c) * math.prod(go(x) for x in kids) for c, kids, _ in chart.edges.get(item, []))
        return mass[item]

    go(chart.goal)
    return mass


def posteriors(chart: Chart) -> dict:
    """Posterior of each item that is in a full derivation."""
    mass = inside(chart)
    total = mass.get(chart.goal, 0.0)
    outside = defaultdict(float, {chart.goal: 1.0})
    order, seen = [], set()

    def visit(item):
        if item not in seen:
            seen.add(item)
            for _, kids, _ in chart.edges.get(item, []):
                for x in kids:
                    visit(x)
            order.append(item)

    visit(chart.goal)
    for item in reversed(order):
        for c, kids, _ in chart.edges.get(item, []):
            for i, x in enumerate(kids):
                outside[x] += outside[item] * math.exp(-c) * math.prod(mass[y] for j, y in enumerate(kids) if j != i)
    return {x: outside[x] * mass[x] / total for x in order} if total else {}


def pruned(chart: Chart, threshold: float = 0.0, k: int = 0) -> set:
    """Items for the next stage: those in the k best derivations, else those whose posterior is above the threshold."""
    if k:
        out = set()
        for _, t in k_best(chart, k):
            out |= {(n.label, frozenset(n.leaves())) for n in t.nodes()}
        return out
    return {x for x, p in posteriors(chart).items() if p > threshold}


def marginal(chart: Chart, k: int, key=str) -> dict[str, float]:
    """Summed probability by tree of the k best derivations."""
    out: dict[str, float] = defaultdict(float)
    for cost, t in k_best(chart, k):
        out[key(t)] += math.exp(-cost)
    return dict(out)


def tree_cost(tree: Tree, words: list[str], g: Grammar) -> float | None:
    """-ln of the probability of a binary tree; None if a rule is missing."""
    from dendrium.functions.treetools import productions

    rules = {(a, (b, c), yf): w for a, b, c, yf, w in g.binary} | {(a, (b,), "0"): w for a, b, w in g.unary}
    total = 0.0
    for lhs, rhs, yf, word in productions(tree, words):
        cost = dict(g.lexicon.get(word, [])).get(lhs) if word is not None else rules.get((lhs, rhs, yf))
        if cost is None:
            return None
        total += cost
    return total


def default_parse(words: list[str], tags: list[str] | None = None, root: str = "NOPARSE") -> Tree:
    """A flat tree for a sentence without a parse."""
    return Tree(root, tuple(Tree(tags[i] if tags else "X", (i,)) for i in range(len(words))))


def partial_parse(chart: Chart) -> Tree:
    """Longest best items from the left, words without one as NOPARSE."""
    n = len(chart.words)
    kids, at = [], 0
    while at < n:
        here = [x for x in chart.best if min(x[1]) == at and len(ranges(x[1])) == 1]
        if not here:
            kids.append(Tree("NOPARSE", (at,)))
            at += 1
            continue
        item = max(here, key=lambda x: (len(x[1]), -chart.best[x][0]))
        kids.append(derivation(chart, item))
        at += len(item[1])
    return Tree("NOPARSE", tuple(kids))


def generate(g: Grammar, rng, most: int = 200) -> list[str]:
    """A random sentence of a continuous grammar, rules drawn by their probabilities."""
    words = defaultdict(list)
    for w, entries in g.lexicon.items():
        for tag, c in entries:
            words[tag].append(((w,), c))
    rules = defaultdict(list)
    for lhs, a, b, _, c in g.binary:
        rules[lhs].append(((a, b), c))
    for lhs, a, c in g.unary:
        rules[lhs].append(((a,), c))
    out, stack = [], [g.root]
    while stack and len(out) < most:
        top = stack.pop()
        options = [(rhs, c, False) for rhs, c in rules[top]] + [(rhs, c, True) for rhs, c in words[top]]
        rhs, _, lexical = rng.choices(options, [math.exp(-c) for _, c, _ in options])[0]
        if lexical:
            out += rhs
        else:
            stack += reversed(rhs)
    return out


def parse_all(sents, grammar: Grammar, k: int = 1):
    """For a DataFrame (sent long, words array<string>): (sent, rank, tree, cost), the k best derivations of each sentence, and
    for one without any a partial parse with rank 0 and no cost. The grammar is broadcast."""
    shipped = sents.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for sent, words in zip(pdf.sent, pdf.words, strict=True):
                chart = parse(list(words), shipped.value, exhaustive=k > 1)
                found = [(chart.best[chart.goal][0], derivation(chart))] if k == 1 and chart.parsed() else k_best(chart, k) if chart.parsed() else []
                out += [(sent, i, str(t), c) for i, (c, t) in enumerate(found, 1)] or [(sent, 0, str(partial_parse(chart)), None)]
            yield pd.DataFrame(out, columns=["sent", "rank", "tree", "cost"])

    return sents.mapInPandas(run, "sent long, rank int, tree string, cost double")
