"""Tree fragments: queries for fragments of any shape, and mining of what trees have in common.

A node row has corpus, sentno, nid, parent, side (which child it is, from 1), depth, label and prod; there is one for every
node that has children or a word. prod is the label followed by the children's labels, or by "=" and the word. A
fragment is a connected part of a tree, written as in "(S (NP ) (VP (V saw) (NP )))"; a node without children is open.

Queries are twig joins: every closed node of a fragment asks for the nodes with its production in its slot, and levels are
joined upwards on the parent, all fragments of a batch in one plan.

Mining works on classes, not on nodes: nodes with equal subtrees are one class, made bottom-up, a level a join. What two nodes
have in common from their tops on depends on their classes only, and occurrences are counted as sums over classes. Chains, subtrees in
which no node has two children with rows, are followed downwards by what they begin with; pairs of classes of which one branches are
compared, once each. The cost is that of different subtrees, however often they occur.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.operators import batches
from dendrium.operators.staging import dropped, once, staged

NODE = ["corpus", "sentno", "nid"]
_TOKEN = re.compile(r"\(|\)|[^\s()]+")

#: Meetings of two trees on a production in a task of kernel() on average, at most; productions of the trees of one group there; meetings at a time.
CELL, POSTINGS, MEET = 16_000_000, 1_000_000, 1_000_000


def prod_of(label: Column, kids: Column, word: Column | None = None) -> Column:
    """The production of a node: over labels (an array), or over a word where that is not null."""
    over = F.concat_ws(" ", label, F.array_join(kids, " "))
    return over if word is None else F.when(word.isNotNull(), F.concat(label, F.lit(" ="), word)).otherwise(over)


# --- queries


def parsed(text: str) -> tuple:
    """(label, children) of a fragment; children are such pairs, or one word, or none for an open node."""
    tokens, at = _TOKEN.findall(text), 0

    def node():
        nonlocal at
        if at + 1 >= len(tokens) or tokens[at] != "(" or tokens[at + 1] in "()":
            raise ValueError(f"a bracket and a label are expected at token {at} of {text!r}")
        label, kids, at = tokens[at + 1], [], at + 2
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at] == "(":
                kids.append(node())
            else:
                kids.append(tokens[at])
                at += 1
        if at == len(tokens):
            raise ValueError(f"a bracket is not closed in {text!r}")
        at += 1
        if any(isinstance(k, str) for k in kids) and len(kids) > 1:
            raise ValueError(f"a word stands beside other children in {text!r}")
        return label, tuple(kids)

    out = node()
    if at != len(tokens):
        raise ValueError(f"{text!r} goes on after its end")
    if not out[1]:
        raise ValueError(f"the root of {text!r} is open")
    return out


def compiled(fragments: dict[str, str]) -> list[tuple]:
    """A row for each closed node of named fragments: frag, q (its number), up (that of the node above, null at the root),
    slot (which child it is), prod, need (closed children) and height above its lowest closed node."""
    rows = []
    for name, text in fragments.items():
        count = 0

        def walk(node, up, slot, name=name):
            nonlocal count
            label, kids = node
            q, height, need, count = count, 0, 0, count + 1
            for i, k in enumerate(kids, 1):
                if not isinstance(k, str) and k[1]:
                    height, need = max(height, 1 + walk(k, q, i)), need + 1
            word = bool(kids) and isinstance(kids[0], str)
            rows.append((name, q, up, slot, f"{label} ={kids[0]}" if word else " ".join([label, *(k[0] for k in kids)]), need, height))
            return height

        walk(parsed(text), None, None)
    return rows


def query_table(spark: SparkSession, fragments: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(compiled(fragments), "frag string, q int, up int, slot int, prod string, need int, height int")


def production_index(nodes: DataFrame) -> DataFrame:
    """(prod, trees, n): how many trees have the production, and how often it occurs."""
    per = nodes.groupBy("prod", "corpus", "sentno").agg(F.count("*").alias("n"))
    return per.groupBy("prod").agg(F.count("*").alias("trees"), F.sum("n").alias("n"))


def postings(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(frag, q, up, need, height, corpus, sentno, nid, parent): the nodes with a query node's production and in its slot."""
    fits = F.col("slot").isNull() | (F.col("slot") == F.col("side"))
    return nodes.select(*NODE, "parent", "side", "prod").join(F.broadcast(queries), "prod").where(fits).select("frag", "q", "up", "need", "height", *NODE, "parent")


def candidates(nodes: DataFrame, fragments: dict[str, str]) -> DataFrame:
    """(frag, corpus, sentno): trees that have all productions of a fragment, wherever."""
    q = query_table(nodes.sparkSession, fragments).select("frag", "prod").distinct()
    wanted = q.groupBy("frag").agg(F.count("*").alias("wanted"))
    has = nodes.select("corpus", "sentno", "prod").join(F.broadcast(q), "prod").groupBy("frag", "corpus", "sentno").agg(F.countDistinct("prod").alias("k"))
    return has.join(F.broadcast(wanted), "frag").where("k = wanted").select("frag", "corpus", "sentno")


def search(nodes: DataFrame, fragments: dict[str, str]) -> DataFrame:
    """(frag, corpus, sentno, nid): the roots of all occurrences of named fragments, the whole batch in one plan.

    Query nodes are broadcast: they come from the caller's strings. What has their productions is read once and staged. A level of query nodes is kept where as many children
    as it needs have been found one level below; a fragment of height h takes h joins, in any batch.
    """
    rows = compiled(fragments)
    found = staged(postings(nodes, query_table(nodes.sparkSession, fragments)))
    at = ["frag", "q", *NODE]
    done = found.where("need = 0").drop("height", "need")
    for height in range(1, max((r[6] for r in rows), default=0) + 1):
        kids = done.where("up is not null").groupBy("frag", F.col("up").alias("q"), "corpus", "sentno", F.col("parent").alias("nid")).agg(F.count("*").alias("have"))
        done = done.unionByName(found.where(F.col("height") == height).join(kids, at).where("have = need").drop("height", "need", "have"))
    return done.where("up is null").select("frag", *NODE)


def counts(found: DataFrame, fragments: dict[str, str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(frag, by, n) of all named fragments; without `by`, those that do not occur have n = 0."""
    n = found.groupBy("frag", *by).agg(F.count("*").alias("n"))
    if by:
        return n
    names = found.sparkSession.createDataFrame([(f,) for f in fragments], "frag string")
    return names.join(n, "frag", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# --- mining


def classes(nodes: DataFrame) -> DataFrame:
    """The nodes with cls (the same for equal subtrees), kids (classes by slot, null for a child without a row), height, chain (no node
    of the subtree has two children with rows) and up (the production above), staged. A level of depth is a join of a node's children to it."""
    nodes = once(nodes)  # read again on each level
    deepest = nodes.agg(F.max("depth")).first()[0]
    out, below = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        if below is None:
            here = here.withColumns({"kids": F.expr("cast(map() as map<int, string>)"), "height": F.lit(0), "chain": F.lit(True)})
        else:
            kid = below.groupBy("corpus", "sentno", F.col("parent").alias("nid")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("side", "cls")))).alias("kids"), (F.max("height") + 1).alias("height"), ((F.count("*") < 2) & F.min("chain")).alias("chain"))
            here = here.join(kid, NODE, "left").withColumns({"kids": F.coalesce("kids", F.expr("cast(map() as map<int, string>)")), "height": F.coalesce("height", F.lit(0)), "chain": F.coalesce("chain", F.lit(True))})
        key = F.concat_ws("|", "prod", F.array_join(F.transform(F.map_entries("kids"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"])), ","))
        below = staged(here.withColumn("cls", F.md5(key)))
        out = below if out is None else out.unionByName(below)
    if out is None:
        out = nodes.where("false").withColumns({"kids": F.expr("cast(map() as map<int, string>)"), "height": F.lit(0), "chain": F.lit(True), "cls": F.lit("")})
    above = nodes.select("corpus", "sentno", F.col("nid").alias("parent"), F.col("prod").alias("up"))
    return staged(out.join(above, ["corpus", "sentno", "parent"], "left"))


def dag(classed: DataFrame) -> DataFrame:
    """(cls, label, prod, kids, height, chain, n): every different subtree once, with its occurrences."""
    first = [F.first(c).alias(c) for c in ("label", "prod", "kids", "height", "chain")]
    return classed.groupBy("cls").agg(*first, F.count("*").alias("n"))


def _kinds(classed: DataFrame) -> DataFrame:
    """(prod, cls, chain, up, side, lo, hi): nodes summed up by class, production above and slot, with the least and the greatest tree."""
    tree = F.struct("corpus", "sentno")
    return classed.groupBy("prod", "cls", "chain", "up", "side").agg(F.min(tree).alias("lo"), F.max(tree).alias("hi"))


def _meet() -> Column:
    """Whether nodes a and b begin what they have in common: their parents do not match in the same slot."""
    return F.col("up_a").isNull() | F.col("up_b").isNull() | (F.col("up_a") != F.col("up_b")) | (F.col("side_a") != F.col("side_b"))


def _one_tree() -> Column:
    """Whether all nodes of a and b are in one tree."""
    return (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))


def _with_suffix(df: DataFrame, x: str, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else f"{c}_{x}") for c in df.columns])


def matching(classed: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of classes with equal productions, a <= b without other, that two nodes of different trees have whose
    parents do not match in the same slot: where what they have in common begins. With other, a is of the first treebank
    and b of the other. Pairs of two chains are left out: chains() has what they share."""
    one, two = _with_suffix(_kinds(classed), "a", ("prod",)), _with_suffix(_kinds(classed if other is None else other), "b", ("prod",))
    met = one.where("not chain_a").join(two, "prod").unionByName(one.where("chain_a").join(two.where("not chain_b"), "prod")).where(_meet())
    if other is None:
        met = met.where((F.col("cls_a") <= F.col("cls_b")) & ~_one_tree())
    return met.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()


def chains(classed: DataFrame, other: DataFrame | None = None, count_in: DataFrame | None = None) -> DataFrame:
    """(root, frag, cls): the largest fragments that pairs of chains share, as for matching(), each with all classes, chains or not, of
    count_in (by default of `classed`) from whose top on it occurs; staged.

    What two chains share is a beginning of both, so no classes are paired. Beginnings grow by a node a level, and are followed while
    they are in two trees (or in both treebanks); one is shared as a whole if two nodes that have it differ in what comes next and above.
    Only the different (next, above) of one beginning meet, which are productions, not subtrees. The cost is the depths of the different subtrees, added up.
    """
    banks = {"a": classed} | ({} if other is None else {"b": other})
    within = "a" if count_in is None or count_in is classed else "b" if count_in is other else "c"
    if within == "c":
        banks["c"] = count_in
    kinds = None
    for bank, df in banks.items():
        k = _kinds(df).select("cls", "chain", "up", "side", "lo", "hi", F.lit(bank).alias("bank"))
        kinds = k if kinds is None else kinds.unionByName(k)
    every = None
    for df in banks.values():
        d = df.select("cls", "label", "prod", "kids")
        every = d if every is None else every.unionByName(d)
    name = F.transform(F.filter(F.split("prod", " "), lambda x, i: i > 0), lambda o: F.when(o.startswith("="), F.substring(o, 2, 1 << 20)).otherwise(F.concat(F.lit("("), o, F.lit(" )"))))
    known = every.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("label", "prod", "kids")]).withColumn("over", name)
    # What comes next below the top of a chain; of other classes it is not looked at.
    first = known.select(F.col("cls").alias("kid"), F.col("prod").alias("below"))
    known = known.withColumns({"slot": F.try_element_at(F.map_keys("kids"), F.lit(1)), "kid": F.try_element_at(F.map_values("kids"), F.lit(1))}).join(first, "kid", "left")
    known = staged(known.select(F.col("cls").alias("at"), "label", "over", "kids", F.concat_ws(":", F.col("slot").cast("string"), "below").alias("next")).withColumn("next", F.when(F.size("kids") > 0, F.col("next"))))
    row = ["cls", "chain", "up", "side", "lo", "hi", "bank"]
    new = kinds.withColumns({"at": F.col("cls"), "open": F.lit(""), "close": F.lit(""), "root": F.lit(None).cast("string")})
    levels = []
    while True:
        text = F.concat("open", F.lit("("), "label", F.lit(" "), F.array_join("over", " "), F.lit(")"), "close")
        here = new.join(known, "at").withColumns({"frag": text, "root": F.coalesce("root", "label")})
        here = staged(here.select(*row, "root", "frag", "next", "open", "close", "label", "over", "kids"))
        two = here.where("chain and bank != 'c'").groupBy("frag")
        live = two.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi") if other is None else two.agg(F.countDistinct("bank").alias("n")).where("n = 2")
        kept = staged(here.join(live.select("frag"), "frag", "left_semi"))
        dropped(here)
        levels.append(kept)
        if kept.isEmpty():
            break
        before, after = F.expr("slice(over, 1, i - 1)"), F.expr("slice(over, i + 1, size(over))")
        new = kept.where("size(kids) > 0").select(*row, "root", "open", "close", "label", "over", F.explode("kids").alias("i", "at"))
        left = F.concat("open", F.lit("("), "label", F.lit(" "), F.array_join(before, " "), F.when(F.col("i") > 1, " ").otherwise(""))
        right = F.concat(F.when(F.col("i") < F.size("over"), " ").otherwise(""), F.array_join(after, " "), F.lit(")"), "close")
        new = new.select(*row, "root", "at", left.alias("open"), right.alias("close"))
    rows = None
    for kept in levels:
        part = kept.select(*row, "root", "frag", "next")
        rows = part if rows is None else rows.unionByName(part)
    ends = staged(rows.where("chain and bank != 'c'").groupBy("root", "frag", "next", "up", "side", "bank").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    one, two = _with_suffix(ends, "a", ("root", "frag")), _with_suffix(ends, "b", ("root", "frag"))
    parts = F.col("next_a").isNull() & F.col("next_b").isNull() | ~F.col("next_a").eqNullSafe(F.col("next_b"))
    met = one.join(two, ["root", "frag"]).where(parts & _meet())
    met = met.where(~_one_tree()) if other is None else met.where("bank_a = 'a' and bank_b = 'b'")
    wanted = met.select("root", "frag").distinct()
    out = staged(rows.where(F.col("bank") == within).select("root", "frag", "cls").distinct().join(wanted, ["root", "frag"], "left_semi"))
    dropped(known, ends, *levels)
    return out


def common_parts(pairs: DataFrame, classed: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(a, b, frag, label, prod, kids, height) for the pairs and all pairs of children that match below them: frag is the largest
    fragment that both have from their tops on, kids its closed children by slot, height its levels of them; staged.

    Matching children are followed downwards until no new pair of classes comes up, and fragments put together upwards.
    """
    nodes = dag(classed if other is None else classed.unionByName(other))
    known = staged(nodes.select("cls", "label", "prod", "kids", "height"))
    side = lambda x: known.select(F.col("cls").alias(x), F.col("prod").alias(f"prod_{x}"), F.col("kids").alias(f"kids_{x}"), F.col("height").alias(f"height_{x}"))
    every, new = None, pairs
    while True:
        slots = F.array_intersect(F.map_keys("kids_a"), F.map_keys("kids_b"))
        full = new.join(side("a"), "a").join(side("b"), "b").where("prod_a = prod_b").select("a", "b", F.least("height_a", "height_b").alias("level"), F.transform(slots, lambda s: F.struct(F.col("kids_a")[s].alias("a"), F.col("kids_b")[s].alias("b"), s.alias("slot"))).alias("below"))
        full = staged(full)
        last, every = full.isEmpty(), full if every is None else every.unionByName(full)
        if last:
            break
        new = full.select(F.inline("below")).select("a", "b").distinct().join(every.select("a", "b"), ["a", "b"], "left_anti")
    name = known.select(F.col("cls").alias("a"), "label", "prod", F.filter(F.split("prod", " "), lambda x, i: i > 0).alias("over"))
    every = every.join(name, "a")
    done = None
    for level in range((every.agg(F.max("level")).first()[0] or 0) + 1):
        here = every.where(F.col("level") == level)
        if done is None:
            here = here.withColumns({"kids": F.expr("cast(map() as map<int, string>)"), "height": F.lit(0)})
        else:
            kid = here.select(F.col("a").alias("top_a"), F.col("b").alias("top_b"), F.inline("below")).join(done.select("a", "b", "frag", "height"), ["a", "b"])
            kid = kid.groupBy(F.col("top_a").alias("a"), F.col("top_b").alias("b")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("slot", "frag")))).alias("kids"), (F.max("height") + 1).alias("height"))
            here = here.join(kid, ["a", "b"], "left").withColumns({"kids": F.coalesce("kids", F.expr("cast(map() as map<int, string>)")), "height": F.coalesce("height", F.lit(0))})
        parts = F.transform("over", lambda o, i: F.coalesce(F.col("kids")[i + 1], F.when(o.startswith("="), F.substring(o, 2, 1 << 20)).otherwise(F.concat(F.lit("("), o, F.lit(" )")))))
        made = here.select("a", "b", F.concat(F.lit("("), "label", F.lit(" "), F.array_join(parts, " "), F.lit(")")).alias("frag"), "label", "prod", "kids", "height")
        made = staged(made)
        done = made if done is None else done.unionByName(made)
    return done


def occurrences(parts: DataFrame, classed: DataFrame) -> DataFrame:
    """(frag, cls) for all different fragments of parts: the classes from whose top on the fragment occurs; staged. A fragment is
    put together upwards from its closed children, all fragments at once: what a class's children have is looked up by the fragments."""
    known = staged(dag(classed).select("cls", "prod", F.col("kids").alias("of")))
    frags = staged(parts.groupBy("frag").agg(*[F.first(c).alias(c) for c in ("prod", "kids", "height")]))
    out = staged(frags.where("height = 0").join(known, "prod").select("frag", "cls"))
    kid_at = staged(known.select("cls", "prod", F.explode("of").alias("slot", "kid_cls")))
    for height in range(1, (frags.agg(F.max("height")).first()[0] or 0) + 1):
        slots = frags.where(F.col("height") == height).select("frag", "prod", F.size("kids").alias("k"), F.explode("kids").alias("slot", "kid"))
        hit = kid_at.join(out.select(F.col("frag").alias("kid"), F.col("cls").alias("kid_cls")), "kid_cls").join(slots, ["prod", "slot", "kid"])
        out = out.unionByName(staged(hit.groupBy("frag", "cls").agg(F.count("*").alias("have"), F.first("k").alias("k")).where("have = k").select("frag", "cls")))
    return out


def shared(classed: DataFrame, other: DataFrame | None = None, count_in: DataFrame | None = None) -> DataFrame:
    """(root, frag, cls): all largest fragments that two trees of a treebank have in common, or a tree of it and one of another, with the
    classes of count_in (by default of `classed`) from whose top on they occur; staged. Chains are not paired, all else is."""
    out = chains(classed, other, count_in)
    pairs = staged(matching(classed, other))
    if not pairs.isEmpty():
        parts = common_parts(pairs, classed, other)
        wanted = parts.join(pairs, ["a", "b"], "left_semi").select("frag", F.col("label").alias("root")).distinct()
        at = occurrences(parts, classed if count_in is None else count_in).join(wanted, "frag")
        out = staged(out.unionByName(at.select(*out.columns)).distinct())
    dropped(pairs)
    return out


def recurring(nodes: DataFrame, other: DataFrame | None = None, count_in: DataFrame | None = None) -> DataFrame:
    """(root, frag, n): all largest fragments that two trees of a treebank have in common, or a tree of it and one of another, with
    their exact number of occurrences in count_in (by default in `nodes`)."""
    classed = classes(nodes)
    second = None if other is None else classes(other)
    within = classed if count_in is None else second if count_in is other else classes(count_in)
    at = shared(classed, second, within)
    out = staged(at.join(within.groupBy("cls").agg(F.count("*").alias("n")), "cls").groupBy("root", "frag").agg(F.sum("n").alias("n")))
    dropped(at)
    return out


def relative(counted: DataFrame) -> DataFrame:
    """Adds rel, the share among fragments with the same root; roots are summed up first."""
    total = counted.groupBy("root").agg(F.sum("n").alias("total"))
    return counted.join(total, "root").select(*counted.columns, (F.col("n") / F.col("total")).alias("rel"))


def n_words(frag: Column) -> Column:
    """The words of a written fragment: what stands behind a blank and before a bracket without being one."""
    return F.regexp_count(frag, F.lit(r"(?<= )[^\s()]+(?=\))")).cast("long")


def n_open(frag: Column) -> Column:
    """The open nodes of a written fragment."""
    return F.regexp_count(frag, F.lit(r" \)")).cast("long")


def ranking(counted: DataFrame, words: str, most: int = 250) -> DataFrame:
    """The first by words squared times the root of the frequency, ties by name."""
    return counted.withColumn("score", F.round(F.pow(F.col(words), 2) * F.sqrt("n"), 6)).orderBy(F.desc("score"), "frag").limit(most)


def ewe(nodes: DataFrame) -> DataFrame:
    """(root, frag, w): equal-weight estimates of the recurring fragments: an occurrence counts one over all occurrences in its
    tree; shares by root. Trees meet fragments by classes: a class weighs what its nodes' trees give it."""
    classed = classes(nodes)
    at = shared(classed)
    held = at.groupBy("cls").agg(F.count("*").alias("held"))
    held_nodes = classed.select("corpus", "sentno", "cls").join(held, "cls")
    trees = held_nodes.groupBy("corpus", "sentno").agg(F.sum("held").alias("all"))
    weight = classed.select("corpus", "sentno", "cls").join(trees, ["corpus", "sentno"]).groupBy("cls").agg(F.sum(1 / F.col("all")).alias("u"))
    sums = at.join(weight, "cls").groupBy("root", "frag").agg(F.sum("u").alias("u"))
    total = sums.groupBy("root").agg(F.sum("u").alias("total"))
    return sums.join(total, "root").select("root", "frag", (F.col("u") / F.col("total")).alias("w"))


def different(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every different tree once, as the first (corpus, sentno) that has it: (corpus, sentno, copies), and the nodes of these trees.

    Trees whose rows are the same but for corpus and sentno are made one before classes are, so that copies take no joins; trees that are
    numbered otherwise are made one by the classes of their roots. A tree without corpus or sentno is a copy, but none stands as it."""
    tree = ["corpus", "sentno"]
    first = F.min(F.when(F.col("corpus").isNotNull() & F.col("sentno").isNotNull(), F.struct(*tree))).alias("first")
    rows = nodes.groupBy(*tree).agg(F.sort_array(F.collect_list(F.struct("nid", "parent", "side", "depth", "label", "prod"))).alias("rows"))
    forms = staged(rows.groupBy("rows").agg(F.count("*").alias("copies"), first).where("first is not null").select("first.*", "copies", "rows"))
    classed = classes(forms.select(*tree, F.inline("rows")))
    roots = classed.where("parent is null").select(*tree, "cls").join(forms.select(*tree, "copies"), tree)
    one = staged(roots.groupBy("cls").agg(F.sum("copies").alias("copies"), first).select("first.*", "copies"))
    kept = forms.drop("copies").join(one.select(*tree), tree, "left_semi")
    return one, kept.select(*tree, F.inline("rows"))


def _summed(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ca, a, cb, b, n) for the pairs of trees of a task, which has the trees (c, sentno, twice, left, right, prods, xs) of one cell: those of the one
    group are left, those of the other right, and both if a group meets itself. Some MEET meetings are summed up at a time."""
    parts = [b for b in batch_rows if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    c, sentno, twice, left, right = (t[x].to_numpy() for x in ("c", "sentno", "twice", "left", "right"))
    rank = np.empty(len(c), np.int64)
    rank[np.lexsort((sentno, c))] = np.arange(len(c))
    prods, xs = t["prods"].combine_chunks(), t["xs"].combine_chunks()
    of = np.repeat(np.arange(len(c)), np.diff(prods.offsets.to_numpy()))
    code, x = batches.codes(pa.chunked_array([prods.flatten()])) + 1, xs.flatten().to_numpy()
    there = np.flatnonzero(right[of])
    there = there[np.argsort(code[there], kind="stable")]
    many = np.bincount(code[there], minlength=code.max() + 1)
    begin = np.cumsum(many) - many
    here = np.flatnonzero(left[of])
    meetings = np.cumsum(many[code[here]])
    at, width = 0, len(c)
    while at < len(here):
        done = meetings[at - 1] if at else 0
        upto = np.searchsorted(meetings, done + MEET, "right")
        upto = max(np.searchsorted(of[here], of[here[min(upto, len(here) - 1)]]) if upto < len(here) else upto, np.searchsorted(of[here], of[here[at]], "right"))
        p = here[at:upto]
        n = many[code[p]]
        q = there[np.repeat(begin[code[p]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        low, p = of[p[0]], np.repeat(p, n)
        fits = (rank[of[p]] < rank[of[q]]) | ((of[p] == of[q]) & twice[of[p]]) | ~right[of[p]]
        p, q = p[fits], q[fits]
        pair, weight = (of[p] - low) * width + of[q], x[p] * x[q]
        if len(pair) and (pair.max() + 1) <= 8 * len(pair):
            total = np.bincount(pair, weights=weight)
            pair = np.flatnonzero(total)
            total = total[pair]
        else:
            pair, which = np.unique(pair, return_inverse=True)
            total = np.bincount(which, weights=weight, minlength=len(pair))
        p, q = pair // width + low, pair % width
        swap = rank[p] > rank[q]
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        for k in range(0, len(p), batches.BACK):
            u, v = p[k : k + batches.BACK], q[k : k + batches.BACK]
            yield pa.record_batch({"ca": c[u], "a": sentno[u], "cb": c[v], "b": sentno[v], "n": total[k : k + batches.BACK].astype(np.int64)})
        at = upto


def kernel(nodes: DataFrame, least: int = 1) -> DataFrame:
    """(a_corpus, a, b_corpus, b, n): for pairs of different trees, the number of node pairs with equal productions, if that is
    `least` or more. Equal trees are one row and stand as the first of them; with itself a tree is paired if it occurs
    twice. A tree's productions are counted before trees meet.

    Trees are dealt to groups, and every two groups meet in a task of their own: trees are moved, a row each, once for each group, but no pairs. There
    are as many groups as keep the meetings of a task at CELL on average and its productions at POSTINGS. In a task trees meet
    in batches. The result has a row for each pair, so that it grows with the square of the different trees."""
    one, kept = different(nodes)
    names = staged(one.select("corpus").distinct().orderBy("corpus").select("corpus", F.monotonically_increasing_id().alias("c")))  # numbers in the order of names
    tree = ["corpus", "sentno"]
    per = kept.groupBy(*tree, "prod").agg(F.count("*").alias("x"))
    bags = per.groupBy(*tree).agg(F.collect_list(F.struct(F.coalesce("prod", F.lit("")).alias("prod"), "x")).alias("bag")).join(one, tree).join(F.broadcast(names), "corpus")
    bags = staged(bags.select("c", F.col("sentno").cast("long").alias("sentno"), (F.col("copies") > 1).alias("twice"), F.col("bag.prod").alias("prods"), F.col("bag.x").alias("xs")))
    often = bags.select(F.explode("prods").alias("prod")).groupBy("prod").agg(F.count("*").cast("double").alias("d"))
    meet, postings = (x or 0 for x in often.agg(F.sum(F.col("d") * F.col("d")), F.sum("d")).first())
    groups = max(1, math.ceil(math.sqrt(meet / CELL)), min(6, math.ceil(math.sqrt(meet / MEET))), math.ceil(postings / POSTINGS))
    dealt = bags.withColumn("g", F.pmod(F.xxhash64("c", "sentno"), F.lit(groups)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    lo, hi = F.least("g", "h"), F.greatest("g", "h")
    cell = (F.shiftright(hi * (hi + 1), 1) + lo).alias("cell")
    dealt = dealt.select("c", "sentno", "twice", (F.col("g") <= F.col("h")).alias("left"), (F.col("g") >= F.col("h")).alias("right"), "prods", "xs", cell).repartitionById(groups * (groups + 1) // 2, "cell")
    pairs = dealt.drop("cell").mapInArrow(_summed, "ca long, a long, cb long, b long, n long").where(F.col("n") >= least)
    named = lambda x: F.broadcast(names.select(F.col("c").alias(f"c{x}"), F.col("corpus").alias(f"{x}_corpus")))
    back = lambda x: F.col(x).cast(nodes.schema["sentno"].dataType).alias(x)
    return pairs.join(named("a"), "ca").join(named("b"), "cb").select("a_corpus", back("a"), "b_corpus", back("b"), "n")
