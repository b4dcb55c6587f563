"""Grammars whose rules stand for whole fragments, and the way back from their rules to the fragments.

A fragment becomes a rule from its root to its leaves, without the nodes between. The rule is cut in two's, from the left: node
root}<id:j> covers the first j leaves, and only the first rule, below the plain root, has the fragment's weight. A leaf over a
word w is the tag label@w, with a rule of its own. Labels must hold neither "@" nor "}<" nor braces.

id is told by the fragment alone: half of its MD5, and among fragments with the same half their rank, so different fragments never
share one and no table is sorted as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrium.operators import batches, fragments
from dendrium.operators.staging import dropped, staged

LEAF = r"\(([^\s()]+) ([^\s()]*)\)"


def weighed(at: DataFrame, classed: DataFrame) -> DataFrame:
    """(root, frag, n, u) for the classes (root, frag, cls) that fragments occur from: n occurrences, and u, their sum with each
    counting one over all occurrences in its tree. Trees meet fragments by classes only."""
    held = at.groupBy("cls").agg(F.count("*").alias("held"))
    nodes = classed.select("corpus", "sentno", "cls").join(held, "cls")
    trees = nodes.groupBy("corpus", "sentno").agg(F.sum("held").alias("every"))
    weight = nodes.select("corpus", "sentno", "cls").join(trees, ["corpus", "sentno"]).groupBy("cls").agg(F.count("*").alias("n"), F.sum(1 / F.col("every")).alias("u"))
    return at.join(weight, "cls").groupBy("root", "frag").agg(F.sum("n").alias("n"), F.sum("u").alias("u"))


def double_dop(nodes: DataFrame) -> DataFrame:
    """(root, frag, n, u) of all largest fragments that two trees have in common, and of every single production, so that each
    tree can be derived; staged."""
    classed = fragments.classes(nodes)
    name = F.filter(F.split("prod", " "), lambda x, i: i > 0)
    over = F.transform(name, lambda o: F.when(o.startswith("="), F.substring(o, 2, 1 << 20)).otherwise(F.concat(F.lit("("), o, F.lit(" )"))))
    single = classed.select(F.col("label").alias("root"), F.concat(F.lit("("), "label", F.lit(" "), F.array_join(over, " "), F.lit(")")).alias("frag"), "cls")
    at = staged(fragments.shared(classed).unionByName(single).distinct())
    out = staged(weighed(at, classed))
    dropped(at)
    return out


def _levels(t: batches.Trees, depth: int) -> tuple[np.ndarray, list[str]]:
    """What each node's subtree looks like down to `depth` levels of productions: a number for each node, and what the numbers stand for: the
    label and the production as JSON, then the slot and the same for each child with a row."""
    table = t.table
    label, prod = table["label"].combine_chunks(), table["prod"].combine_chunks()
    of = batches.codes(table["label"]) + 1
    one, first, code = np.unique(of * (table.num_rows + 1) + batches.codes(table["prod"]) + 1, return_index=True, return_inverse=True)
    at = pa.array(first)
    base = [json.dumps(x, ensure_ascii=False) for x in zip(label.take(at).to_pylist(), prod.take(at).to_pylist(), strict=True)]
    kid = np.flatnonzero(t.up >= 0)
    side = batches.ints(table["side"])[0]
    kid = kid[np.lexsort((side[kid], t.up[kid]))]
    many = np.bincount(t.up[kid], minlength=len(t.up))
    begin = np.cumsum(many) - many
    now, names = code, base
    for _ in range(depth - 1):
        new, new_names = np.zeros(len(now), np.int64), []
        for k in np.unique(many):
            rows = np.flatnonzero(many == k)
            below = kid[begin[rows][:, None] + np.arange(k)]
            which = code[rows]
            for j in range(k):
                slot = np.unique(side[below[:, j]] * len(names) + now[below[:, j]], return_inverse=True)[1]
                which = np.unique(which * (slot.max() + 1) + slot, return_inverse=True)[1]
            some, which = np.unique(which, return_index=True, return_inverse=True)[1:]
            new[rows] = which + len(new_names)
            parts = zip(code[rows[some]].tolist(), side[below[some]].tolist(), now[below[some]].tolist(), strict=True)
            new_names += [base[c][:-1] + "".join(f", {i}, {names[x]}" for i, x in zip(sides, kids, strict=True)) + "]" for c, sides, kids in parts]
        now, names = new, new_names
    return now, names


def _fragments(name: list) -> list[str | None]:
    """All fragments of what _levels() names; of a node without a production, none that has a text."""
    label, prod, *rest = name
    if label is None or prod is None:
        return [None]
    closed = {slot: [f for f in _fragments(below) if f is not None] for slot, below in zip(rest[::2], rest[1::2], strict=True)}
    over = [[x[1:] if x.startswith("=") else f"({x} )", *closed.get(slot, [])] for slot, x in enumerate(prod.split(" ")[1:], 1)]
    return [f"({label} {' '.join(choice)})" for choice in product(*over)]


def _each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [_fragments(json.loads(name)) for name in batch.column("name").to_pylist()]
        at = np.repeat(np.arange(len(found)), [len(f) for f in found])
        yield pa.record_batch({"root": batch.column("label").take(pa.array(at)), "frag": pa.array([f for each in found for f in each], pa.string()), **{c: batch.column(c).take(pa.array(at)) for c in ("n", "u")}})


def dop1_seen(nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """dop1(), and (label, seen), how many nodes have each label. A sentence's nodes meet once; what is moved on are the different subtrees, as far
    down as fragments go, with their counts."""

    def run(table: pa.Table, sent: np.ndarray) -> pa.Table:
        t = batches.Trees(table.append_column("pos", pa.nulls(table.num_rows, pa.int32())), sent)
        now, names = _levels(t, depth)
        held, kid = np.ones(len(now)), np.flatnonzero(t.up >= 0)
        for _ in range(depth - 1):
            more = np.ones(len(now))
            np.multiply.at(more, t.up[kid], 1 + held[kid])
            held = more
        share = 1 / np.bincount(sent, weights=held)[sent]
        first = np.unique(now, return_index=True)[1]
        label = table["label"].combine_chunks().take(pa.array(first))
        return pa.table({"label": label, "name": pa.array(names, pa.string()), "n": np.bincount(now).astype(np.int64), "u": np.bincount(now, weights=share)})

    x = nodes.where("sentno is not null and nid is not null").select(*fragments.NODE, "parent", "side", "label", "prod")
    kinds = staged(batches.by_sentence(x, run, "label string, name string, n long, u double", least=200_000).groupBy("label", "name").agg(F.sum("n").alias("n"), F.sum("u").alias("u")))
    counted = staged(kinds.mapInArrow(_each, "root string, frag string, n long, u double").groupBy("root", "frag").agg(F.sum("n").alias("n"), F.sum("u").alias("u")))
    seen = staged(kinds.groupBy("label").agg(F.sum("n").alias("seen")))
    dropped(kinds)
    return counted, seen


def dop1(nodes: DataFrame, depth: int) -> DataFrame:
    """(root, frag, n, u) of all fragments of up to `depth` levels of productions; staged. They are made once for each different
    subtree of so many levels: a child is open, or stands with each of its own fragments of one level less."""
    counted, seen = dop1_seen(nodes, depth)
    dropped(seen)
    return counted


def flattened(counted: DataFrame) -> DataFrame:
    """Adds to fragments id, leaves (labels, or label@word), words ({tag, word} of leaves over words), template (the fragment with
    {0}, {1}, ... for its leaves) and lexical (it is one label over one word, which stays as it is)."""
    pieces = F.split("frag", LEAF, -1)
    template = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("{"), (i - 1).cast("string"), F.lit("}"), p))), "")
    pairs = F.zip_with(F.regexp_extract_all("frag", F.lit(LEAF), 1), F.regexp_extract_all("frag", F.lit(LEAF), 2), lambda a, b: F.struct(a.alias("label"), b.alias("word")))
    tag = lambda x: F.when(x["word"] == "", x["label"]).otherwise(F.concat(x["label"], F.lit("@"), x["word"]))
    half = F.substring(F.md5("frag"), 1, 16)
    x = counted.withColumns({"half": half, "pairs": pairs, "template": template, "lexical": F.col("frag").rlike(f"^{LEAF}$")})
    rank = F.row_number().over(Window.partitionBy("half").orderBy("frag"))
    x = x.withColumn("id", F.when(rank == 1, F.col("half")).otherwise(F.concat("half", F.lit("-"), rank.cast("string"))))
    words = F.transform(F.filter("pairs", lambda p: p["word"] != ""), lambda p: F.struct(tag(p).alias("tag"), p["word"].alias("word")))
    return x.select(*counted.columns, "id", F.transform("pairs", tag).alias("leaves"), words.alias("words"), "template", "lexical")


def dictionary(flat: DataFrame) -> DataFrame:
    """(id, template) for all fragments that are not lexical."""
    return flat.where("not lexical").select("id", "template")


def rules(flat: DataFrame, nodes: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(lhs, rhs, word, n, rel, ewe, bon, shortest): the grammar of flattened fragments. A fragment's first rule has its count, its
    share of the counts and of the equal-weight sums u of its root, 2 to the power of minus its other nodes, times its count over
    the nodes with the root's label, and 0.5; all other rules have 1. `seen` (label, seen) has the numbers of nodes if they are known."""
    total = flat.groupBy("root").agg(F.sum("n").alias("sum_n"), F.sum("u").alias("sum_u"))
    seen = nodes.groupBy("label").agg(F.count("*").alias("seen")) if seen is None else seen
    seen = seen.withColumnRenamed("label", "root")
    inner = (F.regexp_count("frag", F.lit(r"\(")) - 1).cast("double")
    x = flat.join(total, "root").join(seen, "root").withColumns(
        {"rel": F.col("n") / F.col("sum_n"), "ewe": F.col("u") / F.col("sum_u"), "bon": F.pow(F.lit(2.0), -inner) * F.col("n") / F.col("seen"), "shortest": F.lit(0.5)}
    )
    weights = ["n", "rel", "ewe", "bon", "shortest"]
    none = F.lit(None).cast("string")
    k = F.size("leaves")
    cover = lambda j: F.concat("root", F.lit("}<"), "id", F.lit(":"), j.cast("string"), F.lit(">"))
    first = F.when(k <= 2, F.array(cover(k))).otherwise(F.array(cover(k - 1), F.col("leaves")[k - 1]))
    lexical = x.where("lexical").select("root", F.array(F.lit("Epsilon")), F.col("words")[0]["word"], *weights)
    top = x.where("not lexical").select(F.col("root").alias("lhs"), first.alias("rhs"), none.alias("word"), *weights)
    ones = [F.lit(1).cast("long").alias("n"), *[F.lit(1.0).alias(w) for w in weights[1:]]]
    steps = F.sequence(F.when(k <= 2, k).otherwise(k - 1), F.when(k == 1, 1).otherwise(2), F.lit(-1))
    step = lambda j: F.struct(cover(j).alias("lhs"), F.when(j <= 2, F.slice("leaves", 1, j)).otherwise(F.array(cover(j - 1), F.col("leaves")[j - 1])).alias("rhs"))
    chain = x.where("not lexical").select(F.inline(F.transform(steps, step))).select("lhs", "rhs", none.alias("word"), *ones)
    words = x.where("not lexical").select(F.inline("words")).distinct().select(F.col("tag").alias("lhs"), F.array(F.lit("Epsilon")).alias("rhs"), "word", *ones)
    return top.union(lexical).union(chain).union(words)


def _at(label: Column, group: int) -> Column:
    return F.regexp_extract(label, r"\}<([^:>]+):(\d+)>$", group)


def restored(grammar: DataFrame, known: DataFrame) -> DataFrame:
    """(frag, n) from the rules and the dictionary alone: leaves are gathered from the rules by id, tags get their word from their
    rule, and the template is filled."""
    rule = grammar.where("word is null").withColumns({"of": F.col("rhs")[0], "last": F.col("rhs")[F.size("rhs") - 1]})
    on = F.col("of").contains("}<")
    longer = rule.where(on & (F.size("rhs") == 2)).select(_at(F.col("of"), 1).alias("id"), (_at(F.col("of"), 2).try_cast("int") + 1).alias("j"), F.col("last").alias("leaf"))
    low = rule.where(~on).select(_at(F.col("lhs"), 1).alias("id"), F.posexplode("rhs").alias("j", "leaf")).select("id", (F.col("j") + 1).alias("j"), "leaf")
    tags = grammar.where(F.col("word").isNotNull() & F.col("lhs").contains("@")).select(F.col("lhs").alias("leaf"), "word")
    label = F.when(F.col("word").isNull(), F.col("leaf")).otherwise(F.expr("substring(leaf, 1, length(leaf) - length(word) - 1)"))
    leaf = longer.union(low).join(tags, "leaf", "left").select("id", "j", F.concat(F.lit("("), label, F.lit(" "), F.coalesce("word", F.lit("")), F.lit(")")).alias("leaf"))
    leaves = leaf.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "leaf"))), lambda s: s["leaf"]).alias("leaves"))
    pieces = F.split("template", r"\{\d+\}", -1)
    filled = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.col("leaves")[i - 1], p))), "")
    top = rule.where(on & ~F.col("lhs").contains("}<")).select(_at(F.col("of"), 1).alias("id"), "n")
    whole = top.join(known, "id").join(leaves, "id").select(filled.alias("frag"), "n")
    alone = grammar.where(F.col("word").isNotNull() & ~F.col("lhs").contains("@")).select(F.concat(F.lit("("), "lhs", F.lit(" "), "word", F.lit(")")).alias("frag"), "n")
    return whole.union(alone)
