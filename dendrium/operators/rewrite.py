"""Trees rewritten as tables: nodes get new parents or lose their words, then what is left is numbered anew.

A node row has corpus, sentno, nid, parent (null for the root), side, depth, label, pos (the number of its word, from 1, for a node over
one word, else null) and word. Every rewriting keeps other columns and the nids of the nodes that stay. Sentences meet in one shuffle, or in none where
their rows are dealt by sentence as they come, and are rewritten in Arrow batches of whole sentences, several steps in one pass; nodes reach their ancestors by doubled pointers.
A sentence without words left has no rows. Rows without sentno or nid are left out. Repeated rows of a node are an error of the caller's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dendrium.operators import batches
from dendrium.operators.batches import Trees
from dendrium.operators.heads import NODE, SENTENCE, Rules
from dendrium.operators.staging import dropped, staged

#: Tags and words that are punctuation, and words that are cut off at the ends of a sentence.
PUNCT_TAGS = (".", ",", ":", "'", "''", "`", "``", '"', "-LRB-", "-RRB-", "-LSB-", "-RSB-", "-LCB-", "-RCB-", "$,", "$.", "$[", "$(", "let", "LET[]", "SPEC[symb]", "TW[hoofd,vrij]", "PONCT", "PUNCT", "COMMA", "PAREN")
PUNCT_WORDS = (
    ".", ",", "(", ")", ":", "-", '"', ";", "?", "/", "!", "*", "&", "`", "[", "]", "<", ">", "{", "}", "|", "=", "\xc2", "\xab", "\xbb", "\xb7", "\xad", "\\",
    "&bullet;", "..", "...", "....", ".....", "......", "!!", "!!!", "??", "???", "''", "``", ",,", "--", "---", "----", "-LRB-", "-RRB-", "-LCB-", "-RCB-", "-LSB-", "-RSB-", "#LRB#", "#RRB#",
)
PRUNED = ("``", "''", '"', ".")


def is_punct() -> Column:
    """Whether a node over one word is punctuation, by its label or its word."""
    return F.col("pos").isNotNull() & (F.col("label").isin(*PUNCT_TAGS) | F.coalesce(F.col("word").isin(*PUNCT_WORDS), F.lit(False)))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(corpus, sentno, nid, up, far): every node with each node above it and the number of steps between them; staged, each row
    once. As many rows as the depths of all nodes add up to. Parents in a circle raise ValueError."""
    out = new = staged(nodes.where("parent is not null").select(*NODE, F.col("parent").alias("up"), F.lit(1).alias("far")))
    parts, reach = [new], 1
    while True:
        ends, circles = new.where(F.col("far") == reach).agg(F.count("*"), F.count_if(F.col("nid") == F.col("up"))).first()
        if circles:
            dropped(*parts)
            raise ValueError("a node is above itself")
        if not ends:
            out._parts = parts
            return out
        onward = out.select(*SENTENCE, F.col("nid").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        new = staged(new.where(F.col("far") == reach).join(onward, [*SENTENCE, "up"]).select(*NODE, F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far")))
        out, reach = out.unionByName(new), 2 * reach
        parts.append(new)


def rewritten(nodes: DataFrame, *steps: Callable[[Trees], Trees], heads: DataFrame | None = None, **marks: Column) -> DataFrame:
    """The trees after the steps, which run one after the other on whole sentences in a task; staged. `marks` become columns for the steps, with "_" before
    their names; `heads` (corpus, sentno, nid, head) are t.told, a sentence, node and head each. Errors of the steps are raised."""
    x = nodes.where("sentno is not null and nid is not null")
    schema = StructType([StructField(f.name, IntegerType() if f.name in ("side", "depth", "pos") else f.dataType) for f in nodes.schema])
    x = x.withColumns({f"_{name}": c for name, c in marks.items()})
    if with_heads := heads is not None:
        x = x.withColumns({"_head": F.lit(None).cast(heads.schema["head"].dataType), "_told": F.lit(False)})
        x = x.unionByName(heads.where("sentno is not null and nid is not null and head is not null").select(*NODE, F.col("head").alias("_head"), F.lit(True).alias("_told")), allowMissingColumns=True)
    names = nodes.columns

    def run(table: pa.Table, sent: np.ndarray) -> pa.Table:
        told = None
        if with_heads:
            rows = batches.flags(table["_told"])
            about = table.filter(pa.array(rows))
            told = (sent[rows], *(batches.ints(about[c])[0] for c in ("nid", "_head")))
            table, sent = table.filter(pa.array(~rows)), sent[~rows]
        trees = Trees(table, sent)
        trees.told = told
        for step in steps:
            trees = step(trees)
        return trees.table.select(names)

    return batches.made(batches.by_sentence(x, run, schema))


def numbered(nodes: DataFrame) -> DataFrame:
    """The same trees with side, depth and pos made anew: nodes over no word are gone, children stand in the order of their first words, and
    the words that are left are counted from 1. A node whose parent is not there is a root. Staged."""
    return rewritten(nodes, lambda t: batches.numbered(t, t.up))


def reattached(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Trees in which the nodes of (corpus, sentno, nid, to) are children of `to`; nodes that lose their last word go."""
    x = nodes.join(moves.select(*NODE, "to"), NODE, "left")
    return numbered(x.withColumn("parent", F.coalesce("to", "parent")).select(*nodes.columns))


def without(nodes: DataFrame, goes: Column) -> DataFrame:
    """Trees without the nodes over one word for which `goes` is true, and without nodes that have no other."""
    return numbered(nodes.where(F.col("pos").isNull() | ~F.coalesce(goes, F.lit(False))))


def _told_heads(t: Trees) -> tuple[np.ndarray, np.ndarray]:
    """The row of each node's head (-1 where it is not there), and whether one is told."""
    sent, nid, head = t.told
    row, to = t.places.at(sent, nid), t.places.at(sent, head)
    out, has = np.full(len(t.nid), -1), np.zeros(len(t.nid), bool)
    out[row[row >= 0]], has[row[row >= 0]] = to[row >= 0], True
    return out, has


def _raise(t: Trees, head: np.ndarray, has: np.ndarray) -> Trees:
    word, there = batches.head_words(t, head, has)
    batches.ends(t.up)  # parents in a circle are found before they are followed
    # Every node with each of its words, a level upwards at a time.
    at, place, nodes, places = np.flatnonzero(t.over_word), t.pos[t.over_word], [], []
    while len(at):
        nodes.append(at)
        places.append(place)
        above = t.up[at]
        at, place = above[above >= 0], place[above >= 0]
    nodes, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, places))
    if not there[nodes].all():
        raise ValueError("a node has no lexical head")
    order = np.lexsort((places, nodes))
    nodes, places = nodes[order], places[order]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(nodes)), bool), (nodes[1:] != nodes[:-1]) | (places[1:] != places[:-1] + 1)])
    of, lo, hi = nodes[first], places[first], places[np.r_[first[1:], len(places)] - 1] if len(first) else places
    own = (lo <= word[of]) & (word[of] <= hi)
    low, high, has_own = np.zeros(len(t.nid), np.int64), np.zeros(len(t.nid), np.int64), np.zeros(len(t.nid), bool)
    low[of[own]], high[of[own]], has_own[of[own]] = lo[own], hi[own], True
    up = t.up.copy()
    at = np.flatnonzero(has_own & (t.up >= 0))
    above, farthest = t.up[at], np.full(len(at), -1)
    while len(at):
        fits = has_own[above] & (low[above] <= low[at]) & (high[at] <= high[above])
        up[at[fits]] = above[fits]
        farthest = np.where(has_own[above], above, farthest)
        further = t.up[above]
        top = ~fits & (further < 0)
        up[at[top]] = np.where(farthest[top] >= 0, farthest[top], up[at[top]])
        on = ~fits & (further >= 0)
        at, above, farthest = at[on], further[on], farthest[on]
    return batches.numbered(t, up)


def raised(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """Trees without discontinuous nodes. Of a node's runs of adjacent words the one with its lexical head is its own from then on; what
    stands in another is raised to the nearest node above whose own run covers it, the root if none does. `heads` is as made by heads.head_children();
    a node whose chain of heads ends above no word raises ValueError."""
    return rewritten(nodes, lambda t: _raise(t, *_told_heads(t)), heads=heads)


def raised_by(nodes: DataFrame, rules: str) -> DataFrame:
    """raised() with the heads that head_children() finds by these rules: found where trees are rewritten, they are not moved."""
    found = Rules(rules)
    return rewritten(nodes, lambda t: _raise(t, *found.head_rows(t)), **found.columns(nodes))


def punct_removed(nodes: DataFrame, punct: Column | None = None) -> DataFrame:
    """Trees without punctuation."""
    return without(nodes, is_punct() if punct is None else punct)


def root_words_removed(nodes: DataFrame) -> DataFrame:
    """Trees without the words right below the root, punctuation or not."""
    return without(nodes, (F.col("depth") == 1) & F.col("pos").isNotNull())


def _prune(t: Trees) -> Trees:
    inside = t.over_word & ~batches.flags(t.table["_mark"])
    n = int(t.sent[-1]) + 1 if len(t.sent) else 0
    lo, hi = np.full(n, batches.FAR), np.full(n, -batches.FAR)
    np.minimum.at(lo, t.sent[inside], t.pos[inside])
    np.maximum.at(hi, t.sent[inside], t.pos[inside])
    t = t.kept(~t.over_word | ((lo[t.sent] <= t.pos) & (t.pos <= hi[t.sent])))
    return batches.numbered(t, t.up)


def punct_pruned(nodes: DataFrame, cut: tuple[str, ...] = PRUNED) -> DataFrame:
    """Trees without the words of `cut` that stand at the beginning or the end of a sentence, up to the first and behind the last other word."""
    return rewritten(nodes, _prune, mark=F.col("word").isin(*cut))


def to_root(t: Trees) -> Trees:
    """A step of rewritten(): what is marked is hung below its root, a root itself is not."""
    roots = np.flatnonzero(~t.table["parent"].is_valid().to_numpy())
    n = int(t.sent[-1]) + 1 if len(t.sent) else 0
    root = np.full(n, -1)
    root[t.sent[roots][::-1]] = roots[::-1]  # of several, the first
    moves = batches.flags(t.table["_mark"]) & t.table["parent"].is_valid().to_numpy() & (root[t.sent] >= 0)
    return batches.numbered(t, np.where(moves, root[t.sent], t.up))


def punct_to_root(nodes: DataFrame, punct: Column | None = None) -> DataFrame:
    """Trees whose punctuation stands right below the root. A root over a word itself stays as it is."""
    return rewritten(nodes, to_root, mark=is_punct() if punct is None else punct)


def move(t: Trees) -> Trees:
    """A step of rewritten(): what is marked and stands right below the root is hung beside the highest node that begins behind it."""
    depth, _ = batches.ints(t.table["depth"])
    mark = batches.flags(t.table["_mark"]) & t.over_word & (depth == 1)
    words = np.flatnonzero(t.over_word)
    words = words[np.lexsort((t.pos[words], t.sent[words]))]
    # The next word that is no mark, from behind; another sentence's is none.
    other = np.where(mark[words], len(words), np.arange(len(words)))
    ahead = np.r_[np.minimum.accumulate(other[::-1])[::-1], len(words)][1:]
    has = ahead < len(words)
    has[has] = t.sent[words[ahead[has]]] == t.sent[words[has]]
    has &= mark[words]
    marks, after = words[has], t.pos[words[ahead[has]]]
    _, first = batches.ends(t.up, np.where(t.over_word, t.pos, batches.FAR))
    nodes = np.flatnonzero((depth > 0) & (first < batches.FAR))
    nodes = nodes[np.lexsort((nodes, depth[nodes], first[nodes], t.sent[nodes]))]
    nodes = nodes[batches.places_in(batches.dense(t.sent[nodes], first[nodes])) == 0]  # the highest for each place
    starts = batches.Places(t.sent[nodes], first[nodes])
    found = starts.at(t.sent[marks], after)
    up = t.up.copy()
    to = t.up[nodes[found]]
    moves = (found >= 0) & (to >= 0)
    up[marks[moves]] = to[moves]
    return batches.numbered(t, up)


def punct_moved(nodes: DataFrame, punct: Column | None = None) -> DataFrame:
    """Trees whose punctuation below the root stands beside the highest node that begins behind it: marks in a row go along; where nothing but
    marks follows, or what follows is a child of the root, they stay. `punct` may name other words to move, as
    F.col("pos").isNotNull() for all below the root. Other punctuation is not moved, and paired marks are not brought together."""
    return rewritten(nodes, move, mark=is_punct() if punct is None else punct)
