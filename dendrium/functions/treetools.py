"""Structure of single trees: what is done per sentence inside Arrow-backed functions.

A tree is a Tree(label, kids); kids are trees or word positions. All functions return new trees.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache


@dataclass(frozen=True)
class Tree:
    label: str
    kids: tuple = field(default_factory=tuple)

    def leaves(self) -> list[int]:
        return [x for k in self.kids for x in (k.leaves() if isinstance(k, Tree) else [k])]

    def nodes(self):
        yield self
        for k in self.kids:
            if isinstance(k, Tree):
                yield from k.nodes()

    def __str__(self) -> str:
        return f"({self.label} {' '.join(map(str, self.kids))})"

    def is_tag(self) -> bool:
        return len(self.kids) == 1 and not isinstance(self.kids[0], Tree)

    def height(self) -> int:
        return 1 + max((k.height() if isinstance(k, Tree) else 0 for k in self.kids), default=0)


def rebuilt(tree: Tree, f) -> Tree:
    """The tree with f applied to every node, children first; f may return a tree, a list of kids, or None."""

    def go(t):
        kids = []
        for k in t.kids:
            if isinstance(k, Tree):
                new = go(k)
                kids += new if isinstance(new, list) else [] if new is None else [new]
            else:
                kids.append(k)
        return f(Tree(t.label, tuple(kids)))

    return go(tree)


# --- spans ---


def ranges(leaves) -> list[list[int]]:
    """Runs of adjacent numbers."""
    out: list[list[int]] = []
    for x in sorted(leaves):
        if out and out[-1][-1] + 1 == x:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def intervals(leaves) -> list[tuple[int, int]]:
    """(first, last) of each run."""
    return [(r[0], r[-1]) for r in ranges(leaves)]


def fanout(tree: Tree) -> int:
    return len(ranges(tree.leaves()))


def productions(tree: Tree, words: list[str]) -> list[tuple]:
    """(lhs, children's labels, yield function, word): a tag over a word has ('Epsilon',) and no yield function."""
    out = []
    for t in tree.nodes():
        if t.is_tag():
            out.append((t.label, ("Epsilon",), None, words[t.kids[0]]))
            continue
        owner = {x: i for i, k in enumerate(t.kids) for x in (k.leaves() if isinstance(k, Tree) else [k])}
        parts = []
        for run in ranges(owner):
            one = []
            for x in run:
                if not one or one[-1] != owner[x] or fan_breaks(t.kids[owner[x]], x):
                    one.append(owner[x])
            parts.append("".join(map(str, one)))
        out.append((t.label, tuple(k.label if isinstance(k, Tree) else "Epsilon" for k in t.kids), ",".join(parts), None))
    return out


def fan_breaks(kid, x: int) -> bool:
    """Whether a span of the kid begins at x."""
    return isinstance(kid, Tree) and x - 1 not in kid.leaves()


def bracketings(tree: Tree, delete=()) -> dict[tuple, int]:
    """How often each (label, leaves) of a phrase occurs; tags and deleted labels do not count."""
    out: dict[tuple, int] = {}
    for t in tree.nodes():
        if not t.is_tag() and t.label not in delete:
            key = (t.label, tuple(sorted(t.leaves())))
            out[key] = out.get(key, 0) + 1
    return out


# --- binarization ---


def binarize(tree: Tree, factor: str = "right", horizontal: int = 999, vertical: int = 1, mark: str = "|", between: str = ",") -> Tree:
    """At most two children a node; new nodes are L|<...> with at most `horizontal` labels of what they cover (for left
    factoring, of its end). vertical > 1 adds parents' labels."""

    def go(t, above):
        kids = [go(k, [t.label, *above]) if isinstance(k, Tree) else k for k in t.kids]
        if len(kids) <= 2:
            return Tree(t.label, tuple(kids))
        names = [k.label if isinstance(k, Tree) else str(k) for k in t.kids]
        parents = "^<" + between.join(above[: vertical - 1]) + ">" if vertical > 1 and above else ""
        if factor == "right":
            last = kids[-1]
            for i in range(len(kids) - 2, 0, -1):
                last = Tree(f"{t.label}{mark}<{between.join(names[i:][:horizontal])}>{parents}", (kids[i], last))
            return Tree(t.label, (kids[0], last))
        first = kids[0]
        for i in range(1, len(kids) - 1):
            shown = names[: i + 1]
            first = Tree(f"{t.label}{mark}<{between.join(shown[len(shown) - min(horizontal, len(shown)) :])}>{parents}", (first, kids[i]))
        return Tree(t.label, (first, kids[-1]))

    return go(tree, [])


def unbinarize(tree: Tree, mark: str = "|<") -> Tree:
    """Takes out the nodes that binarize() made."""
    return rebuilt(tree, lambda t: list(t.kids) if mark in t.label else t)


def collapse_unary(tree: Tree, join: str = "+", tags: bool = False) -> Tree:
    """Chains of single children become one node A+B; tags stay apart unless asked for."""

    def one(t):
        k = t.kids[0] if len(t.kids) == 1 else None
        if isinstance(k, Tree) and (tags or not k.is_tag()):
            return Tree(t.label + join + k.label, k.kids)
        return t

    return rebuilt(tree, one)


def expand_unary(tree: Tree, join: str = "+") -> Tree:
    """The inverse of collapse_unary."""

    def one(t):
        *above, last = t.label.split(join)
        out = Tree(last, t.kids)
        for name in reversed(above):
            out = Tree(name, (out,))
        return out

    return rebuilt(tree, one)


def introduce_tags(tree: Tree, words: list[str], label: str = "") -> Tree:
    """A tag (the word itself without a label) over every word that has sisters."""

    def one(t):
        if t.is_tag():
            return t
        return Tree(t.label, tuple(k if isinstance(k, Tree) else Tree(label or words[k], (k,)) for k in t.kids))

    return rebuilt(tree, one)


# --- discontinuity ---


def split_discontinuous(tree: Tree, origin: bool = False) -> Tree:
    """One node L* (L*k with origin) for each span of a discontinuous node."""

    def restricted(t, span):
        kids = []
        for k in t.kids:
            if not isinstance(k, Tree):
                kids += [k] if k in span else []
            elif set(k.leaves()) <= span:
                kids.append(k)
        return tuple(kids)

    def one(t):
        runs = ranges(t.leaves())
        if len(runs) == 1:
            return Tree(t.label, tuple(sorted(t.kids, key=_first)))
        return [Tree(f"{t.label}*{i if origin else ''}", tuple(sorted(restricted(t, set(r)), key=_first))) for i, r in enumerate(runs)]

    return rebuilt(tree, one)


def _first(k) -> int:
    return min(k.leaves()) if isinstance(k, Tree) else k


def merge_discontinuous(tree: Tree) -> Tree:
    """The inverse of split_discontinuous; parts of one parent with one label are one node, or, with origins, each 0 begins
    a new one."""

    def go(t):
        groups: dict[str, list[list]] = {}
        out: list = []
        for k in t.kids:
            m = re.fullmatch(r"(.*)\*(\d*)", k.label) if isinstance(k, Tree) else None
            if not m:
                out.append(k)
                continue
            open_ = groups.setdefault(m[1], [])
            place = int(m[2]) if m[2] else None
            target = next((g for g in open_ if g[0] == place), None) if place else (open_[0] if open_ and place is None else None)
            if target is None:
                target = [None, [], m[1]]
                open_.append(target)
                out.append(target)
            if place is not None:
                target[0] = place + 1
            target[1].extend(k.kids)
        kids = [Tree(k[2], tuple(k[1])) if isinstance(k, list) else k for k in out]
        return Tree(t.label, tuple(sorted((go(k) if isinstance(k, Tree) else k for k in kids), key=_first)))

    return go(tree)


def add_fanout(tree: Tree) -> Tree:
    return rebuilt(tree, lambda t: Tree(f"{t.label}_{fanout(t)}", t.kids) if fanout(t) > 1 else t)


def remove_fanout(tree: Tree) -> Tree:
    return rebuilt(tree, lambda t: Tree(re.sub(r"_\d+$", "", t.label), t.kids))


def remove_words(tree: Tree, words: list[str], goes) -> tuple[Tree | None, list[str]]:
    """Without the words for which goes(word, position) holds and nodes over none but them; words are numbered anew."""
    stay = [i for i, w in enumerate(words) if not goes(w, i)]
    new = {old: i for i, old in enumerate(stay)}

    def go(t):
        kids = tuple(x for k in t.kids for x in ([go(k)] if isinstance(k, Tree) else [new[k]] if k in new else []) if x is not None)
        return Tree(t.label, kids) if kids else None

    return go(tree), [words[i] for i in stay]


def canonical(tree: Tree) -> Tree:
    """Children in the order of their first words."""
    return rebuilt(tree, lambda t: Tree(t.label, tuple(sorted(t.kids, key=_first))))


def continuous_order(tree: Tree, words: list[str]) -> tuple[Tree, list[str]]:
    """Words reordered so that no node is discontinuous."""
    order = canonical(tree).leaves()
    new = {old: i for i, old in enumerate(order)}
    return rebuilt(canonical(tree), lambda t: Tree(t.label, tuple(k if isinstance(k, Tree) else new[k] for k in t.kids))), [words[i] for i in order]


#: What counts as punctuation.
PUNCTUATION = frozenset(".,:;'`\"!?/()-[]{}*@&+=_<>|") | {"``", "''", "--", "...", "-LRB-", "-RRB-"}


def punctuation(tree: Tree, words: list[str], policy: str) -> tuple[Tree | None, list[str]]:
    """Policies: remove (all marks), root (marks under the root), move (marks beside the word before them)."""
    if policy == "remove":
        return remove_words(tree, words, lambda w, _: w in PUNCTUATION)
    tags = [t for t in tree.nodes() if t.is_tag() and words[t.kids[0]] in PUNCTUATION]
    bare = _without(tree, {t.kids[0] for t in tags})
    if bare is None:
        return tree, words
    if policy == "root":
        return canonical(Tree(bare.label, bare.kids + tuple(tags))), words
    if policy != "move":
        raise ValueError(policy)
    for tag in sorted(tags, key=lambda t: t.kids[0]):
        have = set(bare.leaves())
        before = max((x for x in have if x < tag.kids[0]), default=None)
        bare = _attach(bare, before, tag)
    return canonical(bare), words


def _without(tree: Tree, gone: set[int]) -> Tree | None:
    kids = tuple(x for k in tree.kids for x in ([_without(k, gone)] if isinstance(k, Tree) else [k] if k not in gone else []) if x is not None)
    return Tree(tree.label, kids) if kids else None


def _attach(tree: Tree, before: int | None, tag: Tree) -> Tree:
    """The tag as a sister of the largest phrase that ends at the word `before`, below the root where possible."""
    if before is None:
        return Tree(tree.label, (tag, *tree.kids))
    kids = list(tree.kids)
    for i, k in enumerate(kids):
        if isinstance(k, Tree) and not k.is_tag() and before in k.leaves() and max(k.leaves()) != before:
            kids[i] = _attach(k, before, tag)
            return Tree(tree.label, tuple(kids))
    return Tree(tree.label, (*kids, tag))


# --- heads and dependencies ---


def parse_head_rules(text: str) -> dict[str, list[tuple[str, list[str]]]]:
    """Lines `CAT left-to-right|right-to-left LABEL ...`; % begins a comment."""
    out: dict[str, list] = {}
    for line in text.splitlines():
        parts = line.split("%")[0].split()
        if len(parts) > 1:
            out.setdefault(parts[0].upper(), []).append((parts[1].lower(), [p.upper() for p in parts[2:]]))
    return out


def head_of(t: Tree, rules) -> int:
    """Index of the head child: by the rules of the label in order, each looking for its labels in turn from its side; else
    the first child (the last for right-to-left rules without labels)."""
    names = [k.label.upper() if isinstance(k, Tree) else "" for k in t.kids]
    for side, labels in rules.get(t.label.upper(), []):
        order = range(len(names)) if side.startswith("left") else range(len(names) - 1, -1, -1)
        if not labels:
            return order[0]
        for label in labels:
            for i in order:
                if names[i] == label:
                    return i
    return 0


def dependencies(tree: Tree, rules) -> dict[int, int]:
    """The position of each word's head word; -1 for the root's."""
    out: dict[int, int] = {}

    def lexical(t) -> int:
        if not isinstance(t, Tree):
            return t
        at = head_of(t, rules)
        heads = [lexical(k) for k in t.kids]
        for i, h in enumerate(heads):
            if i != at:
                out[h] = heads[at]
        return heads[at]

    out[lexical(tree)] = -1
    return out


def dependency_length(deps: dict[int, int]) -> float:
    arcs = [abs(a - b) for a, b in deps.items() if b >= 0]
    return sum(arcs) / len(arcs) if arcs else 0.0


# --- distances ---


def tree_edit_distance(a: Tree, b: Tree) -> int:
    """Fewest insertions, deletions and relabellings of nodes (words are nodes) between ordered trees."""

    def post(t):
        nodes, left, keys = [], [], {}

        def go(x):
            if not isinstance(x, Tree):
                nodes.append(str(x))
                left.append(len(nodes) - 1)
                return len(nodes) - 1
            firsts = [go(k) for k in x.kids]
            nodes.append(x.label)
            left.append(left[firsts[0]] if firsts else len(nodes) - 1)
            return len(nodes) - 1

        go(t)
        for i, first in enumerate(left):
            keys[first] = i
        return nodes, left, sorted(keys.values())

    na, la, ka = post(a)
    nb, lb, kb = post(b)
    d = [[0] * len(nb) for _ in na]
    for i in ka:
        for j in kb:
            p, q = la[i], lb[j]
            f = [[0] * (j - q + 2) for _ in range(i - p + 2)]
            for x in range(1, i - p + 2):
                f[x][0] = x
            for y in range(1, j - q + 2):
                f[0][y] = y
            for x in range(1, i - p + 2):
                for y in range(1, j - q + 2):
                    u, v = p + x - 1, q + y - 1
                    if la[u] == p and lb[v] == q:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[x - 1][y - 1] + (na[u] != nb[v]))
                        d[u][v] = f[x][y]
                    else:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[la[u] - p][lb[v] - q] + d[u][v])
    return d[-1][-1]


def sequence_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def leaf_ancestor(gold: Tree, candidate: Tree) -> float:
    """Mean over words of 1 - distance / length of the paths of labels from word to root."""

    def paths(t, above=()):
        out = {}
        for k in t.kids:
            out |= paths(k, (t.label, *above)) if isinstance(k, Tree) else {k: (t.label, *above)}
        return out

    g, c = paths(gold), paths(candidate)
    scores = [1 - sequence_distance(g[x], c.get(x, ())) / max(1, len(g[x]) + len(c.get(x, ()))) for x in g]
    return sum(scores) / len(scores) if scores else 0.0


# --- fragments ---


def cover_fragments(tree: Tree, words: list[str], depth: int, frontiers: int = 999) -> dict[str, int]:
    """Every connected fragment up to a depth, with at most so many open nodes, and how often it occurs."""
    counts: dict[str, int] = {}

    @cache
    def parts(t: Tree, d: int) -> tuple[tuple[str, int], ...]:
        """(text, open nodes) of the fragments rooted here."""
        if t.is_tag():
            return ((f"({t.label} {words[t.kids[0]]})", 0),)
        made = [("", 0)]
        for k in t.kids:
            options = [(f"({k.label} )", 1), *(parts(k, d - 1) if d > 1 else ())]
            made = [(f"{a} {b}", x + y) for a, x in made for b, y in options if x + y <= frontiers]
        return tuple((f"({t.label}{a})", x) for a, x in made)

    for t in tree.nodes():
        for text, _ in parts(t, depth):
            counts[text] = counts.get(text, 0) + 1
    return counts


def _binary_nodes(tree: Tree, words: list[str]):
    """Nodes in preorder with production and places of their children."""
    out: list[list] = []

    def go(t):
        at = len(out)
        out.append([None, []])
        if t.is_tag():
            out[at][0] = (t.label, words[t.kids[0]])
        else:
            out[at][0] = (t.label, tuple(k.label for k in t.kids), tuple(p for p in productions(Tree(t.label, t.kids), words)[:1]))
            out[at][1] = [go(k) for k in t.kids]
        return at

    go(tree)
    return out


def common_fragments(a: Tree, words_a: list[str], b: Tree, words_b: list[str]) -> set[str]:
    """The largest fragments that two trees share: sets of node pairs with equal productions, connected through equal child
    places, none inside another of the same pair of trees."""
    x, y = _binary_nodes(a, words_a), _binary_nodes(b, words_b)
    by: dict = {}
    for j, (p, _) in enumerate(y):
        by.setdefault(p, []).append(j)
    pairs = {(i, j) for i, (p, _) in enumerate(x) for j in by.get(p, ())}
    inner = {(k, m) for i, j in pairs for k, m in zip(x[i][1], y[j][1], strict=True) if (k, m) in pairs}

    def text(i, j) -> str:
        prod, kids = x[i]
        if not kids:
            return f"({prod[0]} {prod[1]})"
        return f"({prod[0]} {' '.join(text(k, m) if (k, m) in pairs else f'({prod[1][n]} )' for n, (k, m) in enumerate(zip(kids, y[j][1], strict=True)))})"

    return {text(i, j) for i, j in pairs - inner}


def count_fragment(fragment: str, tree: Tree, words: list[str]) -> int:
    """How often a fragment (as text) occurs in a tree."""
    want = parse_fragment(fragment)

    def fits(f, t) -> bool:
        if not isinstance(t, Tree) or f[0] != t.label:
            return False
        if not f[1]:
            return True
        if isinstance(f[1][0], str):
            return t.is_tag() and words[t.kids[0]] == f[1][0]
        return not t.is_tag() and len(f[1]) == len(t.kids) and all(isinstance(k, Tree) and p[0] == k.label for p, k in zip(f[1], t.kids, strict=True)) and all(fits(p, k) for p, k in zip(f[1], t.kids, strict=True))

    return sum(fits(want, t) for t in tree.nodes())


def parse_fragment(text: str):
    """(label, kids); kids is empty for an open node and holds a string over a word."""
    tokens = re.findall(r"[()]|[^\s()]+", text)
    at = 0

    def go():
        nonlocal at
        at += 1
        label = tokens[at]
        at += 1
        kids = []
        while tokens[at] != ")":
            if tokens[at] == "(":
                kids.append(go())
            else:
                kids.append(tokens[at])
                at += 1
        at += 1
        return (label, kids)

    return go()
