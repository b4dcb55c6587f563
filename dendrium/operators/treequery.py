"""Tree patterns, compiled to self-joins of the node table.

A pattern is a node test followed by relations to other patterns, as in ``S << (NP $. VP) !< /^w1/``:

- node test: a label, ``*`` or ``__`` (any), ``/regex/``, ``a|b`` (either label); a leading ``!`` on a test negates it;
- relations: see RELATIONS; ``<N`` and ``>N`` take a number, ``<-N`` counts from the end;
- relations of one node are joined by ``&`` or by nothing, and by ``|`` for alternatives (which bind less); ``!`` before a
  relation demands that no such node exists; brackets group a pattern with relations of its own; ``[ ]`` groups relations;
- ``=name`` after a test names a node: later uses of ``=name`` alone stand for that very node.

Every relation is an equi-join on the sentence, with what is left as a condition, so no join is a cross product;
positive relations of the head keep all assignments, negations are anti-joins, alternatives are unions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INVERSE = {"<": ">", ".": ",", "$": "$"}
#: What holds between node a and node b, by relation.
RELATIONS = {
    "<": lambda a, b: b("parent") == a("nid"),
    "<,": lambda a, b: (b("parent") == a("nid")) & (b("ix") == 1),
    "<-": lambda a, b: (b("parent") == a("nid")) & (b("ix") == a("nchild")),
    "<:": lambda a, b: (b("parent") == a("nid")) & (a("nchild") == 1),
    "<<": lambda a, b: below(a, b),
    "<<,": lambda a, b: below(a, b) & (a("s") == b("s")),
    "<<`": lambda a, b: below(a, b) & (a("e") == b("e")),
    "<<:": lambda a, b: below(a, b) & (a("s") == b("s")) & (a("e") == b("e")),
    ".": lambda a, b: a("e") == b("s"),
    "..": lambda a, b: a("e") <= b("s"),
    "$": lambda a, b: (a("parent") == b("parent")) & (a("nid") != b("nid")),
    "$.": lambda a, b: (a("parent") == b("parent")) & (a("ix") + 1 == b("ix")),
    "$..": lambda a, b: (a("parent") == b("parent")) & (a("ix") < b("ix")),
    "=": lambda a, b: a("nid") == b("nid"),
}
_SAME = {"<`": "<-"}
_FLIPPED = {
    ">": "<", ">,": "<,", ">-": "<-", ">`": "<-", ">:": "<:", ">>": "<<", ">>,": "<<,", ">>`": "<<`", ">>:": "<<:", ",": ".", ",,": "..", "$,": "$.", "$,,": "$..",
}
_TOKEN = re.compile(r"\s*(?:(?P<rel><<[,`:]?|>>[,`:]?|<-?\d+|>-?\d+|<[,\-`:]?|>[,\-`:]?|\$\.\.|\$,,|\$[.,]?|\.\.|,,|[.,])|(?P<re>/(?:[^/\\]|\\.)*/)|(?P<p>[()\[\]&|!])|(?P<name>=[A-Za-z_]\w*)|(?P<eq>=)|(?P<q>\"[^\"]*\")|(?P<label>[^\s()\[\]&|!<>.,$=/\"]+))")


def below(a, b) -> Column:
    return (a("nid") < b("nid")) & (b("nid") <= a("last"))


@dataclass
class Node:
    """A node test and its relations, as alternatives of conjunctions of (negated, relation, node)."""

    test: str | None = None
    regex: bool = False
    negated: bool = False
    name: str | None = None
    groups: list = field(default_factory=lambda: [[]])


def relation(token: str, a, b) -> Column:
    """The join condition of a relation token between a and b (functions from column name to Column)."""
    token = _SAME.get(token, token)
    if m := re.fullmatch(r"([<>])(-?)(\d+)", token):
        parent, child = (a, b) if m[1] == "<" else (b, a)
        n = int(m[3])
        return (child("parent") == parent("nid")) & (child("ix") == (parent("nchild") - n + 1 if m[2] else F.lit(n)))
    if token in _FLIPPED:
        return RELATIONS[_FLIPPED[token]](b, a)
    return RELATIONS[token](a, b)


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the pattern at {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def next(self):
        out = self.peek()
        self.at += 1
        return out

    def node(self) -> Node:
        kind, value = self.peek()
        if (kind, value) == ("p", "("):
            self.next()
            out = self.pattern()
            if self.next() != ("p", ")"):
                raise ValueError("a bracket is not closed")
            return out
        out = Node()
        if (kind, value) == ("p", "!"):
            self.next()
            out.negated = True
            kind, value = self.peek()
        if kind == "name":
            self.next()
            out.name = value[1:]
            return out
        if kind not in ("label", "re", "q"):
            raise ValueError(f"a node test is missing before {value!r}")
        self.next()
        if kind == "re":
            out.test, out.regex = value[1:-1], True
        else:
            out.test = value.strip('"')
            while self.peek() == ("p", "|") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] in ("label", "q"):
                self.next()
                out.test += "\0" + self.next()[1].strip('"')
        if self.peek()[0] == "name":
            out.name = self.next()[1][1:]
        return out

    def pattern(self) -> Node:
        head = self.node()
        head.groups = self.alternatives(lambda: self.peek() in ((None, None), ("p", ")"), ("p", "]")))
        return head

    def alternatives(self, ends) -> list:
        groups = [[]]
        while not ends():
            kind, value = self.peek()
            if (kind, value) == ("p", "|"):
                self.next()
                groups.append([])
            elif (kind, value) == ("p", "&"):
                self.next()
            elif (kind, value) == ("p", "["):
                self.next()
                inner = self.alternatives(lambda: self.peek() in ((None, None), ("p", "]")))
                if self.next() != ("p", "]"):
                    raise ValueError("a square bracket is not closed")
                groups = [*groups[:-1], *[groups[-1] + g for g in inner]]
            else:
                negated = (kind, value) == ("p", "!")
                if negated:
                    self.next()
                    kind, value = self.peek()
                if kind == "eq":
                    kind, value = "rel", "="
                if kind != "rel":
                    raise ValueError(f"a relation is missing before {value!r}")
                self.next()
                groups[-1] = [*groups[-1], (negated, value, self.node())]
        return groups


def parse(pattern: str) -> Node:
    p = _Parser(pattern)
    out = p.pattern()
    if p.peek() != (None, None):
        raise ValueError(f"cannot read the pattern from {p.peek()[1]!r} on")
    return out


def expand_macros(pattern: str, macros: dict[str, str] | None) -> str:
    """{name} stands for the macro of that name."""
    return re.sub(r"\{(\w+)\}", lambda m: macros[m[1]], pattern) if macros else pattern


def _test(node: Node, label: Column) -> Column:
    if node.test in (None, "*", "__"):
        ok = F.lit(True)
    elif node.regex:
        ok = label.rlike(node.test)
    else:
        ok = label.isin(*node.test.split("\0"))
    return ~ok if node.negated else ok


KEY = ("corpus", "sentno")
_USED = ("nid", "last", "parent", "ix", "nchild", "s", "e", "label")


def matches(nodes: DataFrame, pattern: str, macros: dict[str, str] | None = None) -> DataFrame:
    """(corpus, sentno, nid, last, label, s, e) of the head node, a row for each assignment of the positive relations."""
    head = parse(expand_macros(pattern, macros))
    count = 0

    def side(node: Node) -> tuple[DataFrame, str]:
        nonlocal count
        count += 1
        p = f"n{count}_"
        columns = [F.col(k).alias(p + k) for k in KEY] + [F.col(c).alias(p + c) for c in _USED]
        return nodes.where(_test(node, F.col("label"))).select(*columns), p

    def match(node: Node, outer: DataFrame, p: str, names: dict[str, str]) -> tuple[DataFrame, list[tuple[str, Column]]]:
        """outer with the relations of the node whose columns begin with p, and conditions (on a named node's prefix) that wait
        until that node is joined."""
        parts, waiting = [], []
        for group in node.groups:
            df, known = outer, dict(names) | ({node.name: p} if node.name else {})
            for negated, token, other in sorted(group, key=lambda x: x[0]):  # negations last
                a = lambda c, p=p: F.col(p + c)
                if other.name and other.name in known and other.test is None:
                    q = known[other.name]
                    holds = relation(token, a, lambda c, q=q: F.col(q + c))
                    holds = ~holds if negated else holds
                    if q + "nid" in df.columns:
                        df = df.where(holds)
                    elif len(node.groups) == 1:
                        waiting.append((q, holds))
                    else:
                        raise ValueError("a node named outside cannot be used among alternatives")
                    continue
                right, q = side(other)
                right, later = match(other, right, q, known)
                on = relation(token, a, lambda c, q=q: F.col(q + c))
                for k in KEY:
                    on = on & (F.col(p + k) == F.col(q + k))
                for name, holds in later:
                    if name + "nid" in df.columns:
                        on = on & holds
                    elif negated:
                        raise ValueError("a node named outside a negation must be joined before it")
                    else:
                        waiting.append((name, holds))
                df = df.join(right, on, "left_anti" if negated else "inner")
                if not negated and other.name:
                    known[other.name] = q
            parts.append(df)
        if len(parts) == 1:
            return parts[0], waiting
        keep = outer.columns
        out = parts[0].select(*keep)
        for x in parts[1:]:
            out = out.union(x.select(*keep))
        return out.distinct(), waiting

    left, p = side(head)
    out, waiting = match(head, left, p, {})
    if waiting:
        raise ValueError("a name is used before its node")
    return out.select(*[F.col(p + c).alias(c) for c in (*KEY, "nid", "last", "label", "s", "e")])


def counts(nodes: DataFrame, pattern: str, corpora: DataFrame | None = None, start: int | None = None, end: int | None = None, macros=None) -> DataFrame:
    """(corpus, n): matches for each corpus, those without any too if corpora (corpus) is given. start and end are the
    first and last sentence number, inclusive."""
    part = between(nodes, start, end)
    found = matches(part, pattern, macros).groupBy("corpus").agg(F.count("*").alias("n"))
    return found if corpora is None else corpora.join(found, "corpus", "left").select("corpus", F.coalesce("n", F.lit(0)).alias("n"))


def between(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("sentno") >= start)
    return df if end is None else df.where(F.col("sentno") <= end)


def indices(nodes: DataFrame, pattern: str) -> DataFrame:
    """(corpus, sentno, n): sentences with matches, and how many."""
    return matches(nodes, pattern).groupBy(*KEY).agg(F.count("*").alias("n"))


def breakdown(nodes: DataFrame, pattern: str) -> DataFrame:
    """(corpus, match, n): by the words of the matching node."""
    found = matches(nodes, pattern).groupBy(*KEY, "nid", "last").agg(F.count("*").alias("times"))
    words = nodes.where("is_word").select(*[F.col(k).alias(f"w_{k}") for k in KEY], F.col("nid").alias("w_nid"), "word")
    inside = found.join(words, (F.col("corpus") == F.col("w_corpus")) & (F.col("sentno") == F.col("w_sentno")) & (F.col("w_nid") >= F.col("nid")) & (F.col("w_nid") <= F.col("last")))
    text = inside.groupBy(*KEY, "nid", "times").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w_nid", "word"))), lambda e: e["word"]), " ").alias("match"))
    return text.groupBy("corpus", "match").agg(F.sum("times").alias("n"))


def batch_counts(nodes: DataFrame, corpora: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(corpus, one column for each query): zeros are kept."""
    rows = None
    for name, pattern in patterns.items():
        one = matches(nodes, pattern).groupBy("corpus").agg(F.count("*").alias("n")).select("corpus", F.lit(name).alias("query"), "n")
        rows = one if rows is None else rows.union(one)
    wide = rows.groupBy("corpus").pivot("query", list(patterns)).agg(F.sum("n"))
    return corpora.join(wide, "corpus", "left").select("corpus", *[F.coalesce(q, F.lit(0)).alias(q) for q in patterns])


def first_sentences(nodes: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """(corpus, sentno, nid, n_matches): the first matching sentences of each corpus, at most limit; nid is the first."""
    found = matches(nodes, pattern).groupBy(*KEY).agg(F.min("nid").alias("nid"), F.count("*").alias("n_matches"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("corpus").orderBy("sentno"))
    return found.withColumn("r", rank).where(F.col("r") <= limit).drop("r")


def subtrees(nodes: DataFrame, pattern: str) -> DataFrame:
    """The nodes of each matching subtree: (corpus, sentno, top, nid, label, is_word)."""
    found = matches(nodes, pattern).select(*[F.col(k).alias(f"m_{k}") for k in KEY], F.col("nid").alias("top"), F.col("last").alias("upto")).distinct()
    on = (F.col("corpus") == F.col("m_corpus")) & (F.col("sentno") == F.col("m_sentno")) & (F.col("nid") >= F.col("top")) & (F.col("nid") <= F.col("upto"))
    return nodes.join(found, on).select(*KEY, "top", "nid", "label", "is_word")


def info(nodes: DataFrame) -> DataFrame:
    """(corpus, sentences, words, nodes, most_nodes) for each corpus; words are not counted as nodes."""
    per = nodes.groupBy(*KEY).agg(F.sum(F.col("is_word").cast("int")).alias("w"), F.sum((~F.col("is_word")).cast("int")).alias("k"))
    return per.groupBy("corpus").agg(F.count("*").alias("sentences"), F.sum("w").alias("words"), F.sum("k").alias("nodes"), F.max("k").cast("long").alias("most_nodes"))
