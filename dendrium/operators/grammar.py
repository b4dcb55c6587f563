"""Grammar induction: counting and normalizing productions, and what is done with rule tables.

A rule row is (lhs, rhs array, yf, word, n or p); yf is the yield function, word is null but for lexical rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN10 = 9


def productions(nodes: DataFrame) -> DataFrame:
    """For the node table of continuous trees: (corpus, sentno, nid, lhs, rhs, word) of every node over others. A node over
    one word is a lexical rule."""
    kids = nodes.where(F.col("parent").isNotNull()).groupBy("corpus", "sentno", F.col("parent").alias("nid")).agg(
        F.sort_array(F.collect_list(F.struct("ix", "label", "is_word"))).alias("kids")
    )
    heads = nodes.where(~F.col("is_word")).select("corpus", "sentno", "nid", F.col("label").alias("lhs"))
    lexical = (F.size("kids") == 1) & F.col("kids")[0]["is_word"]
    return heads.join(kids, ["corpus", "sentno", "nid"]).select(
        "corpus", "sentno", "nid", "lhs", F.when(lexical, F.array(F.lit("Epsilon"))).otherwise(F.col("kids.label")).alias("rhs"), F.when(lexical, F.col("kids")[0]["label"]).alias("word")
    )


def rule_key() -> Column:
    return F.concat_ws(" ", "lhs", F.lit("->"), F.array_join("rhs", " "), F.coalesce("word", F.lit("")))


def treebank_grammar(prods: DataFrame, pseudo: int = 0) -> DataFrame:
    """(lhs, rhs, word, n): how often each production occurs."""
    return prods.groupBy("lhs", "rhs", "word").agg((F.count("*") + pseudo).alias("n"))


def relative(grammar: DataFrame) -> DataFrame:
    """Adds p, the share of the rule among those with its lhs."""
    return grammar.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lhs")))


def sums_to_one(weighted: DataFrame) -> DataFrame:
    """(lhs, off): how far the weights of each lhs are from one."""
    return weighted.groupBy("lhs").agg(F.abs(F.sum("p") - 1).alias("off"))


def yield_functions(leaves: DataFrame) -> DataFrame:
    """For (sentno, label, leaf), the children of one root: (sentno, yf): runs of leaves by child, children numbered by their
    first leaf, runs that are not adjacent apart by commas."""
    w = Window.partitionBy("sentno").orderBy("leaf")
    first = leaves.groupBy("sentno", "label").agg(F.min("leaf").alias("first"))
    first = first.withColumn("child", F.row_number().over(Window.partitionBy("sentno").orderBy("first")) - 1).select("sentno", "label", "child")
    x = leaves.join(first, ["sentno", "label"]).withColumns({"before": F.lag("child").over(w), "gap": F.col("leaf") - F.lag("leaf").over(w)})
    runs = x.where(F.col("before").isNull() | (F.col("before") != F.col("child")) | (F.col("gap") > 1))
    part = F.concat(F.when(F.col("gap") > 1, ",").otherwise(""), F.col("child").cast("string"))
    return runs.withColumn("part", part).groupBy("sentno").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leaf", "part"))), lambda e: e["part"]), "").alias("yf"))


def spans(leaves: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, last): the separated spans of each node's leaves."""
    run = F.col("leaf") - F.row_number().over(Window.partitionBy(*by).orderBy("leaf"))
    return leaves.withColumn("run", run).groupBy(*by, "run").agg(F.min("leaf").alias("first"), F.max("leaf").alias("last")).drop("run")


def fanout(leaves: DataFrame, by: list[str]) -> DataFrame:
    """(by, fanout): the number of spans."""
    return spans(leaves, by).groupBy(*by).agg(F.count("*").alias("fanout"))


def statistics(grammar: DataFrame) -> DataFrame:
    """(lhs, rules, lexical, mass): rules of each label."""
    return grammar.groupBy("lhs").agg(F.count("*").alias("rules"), F.count("word").alias("lexical"), F.sum("n").alias("mass"))


def complexity(grammar: DataFrame) -> DataFrame:
    """(arity, rules, mass): how many rules have how many children."""
    return grammar.groupBy(F.size("rhs").alias("arity")).agg(F.count("*").alias("rules"), F.sum("n").alias("mass"))


def merge(grammars: list[DataFrame]) -> DataFrame:
    """(lhs, rhs, word, p): the mean of the weights over all grammars, a missing rule counting 0."""
    rows = grammars[0].select("lhs", "rhs", "word", "p")
    for g in grammars[1:]:
        rows = rows.union(g.select("lhs", "rhs", "word", "p"))
    return rows.groupBy("lhs", "rhs", "word").agg((F.sum("p") / len(grammars)).alias("p"))


def not_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rules of a that b does not have."""
    same = a.lhs.eqNullSafe(b.lhs) & a.rhs.eqNullSafe(b.rhs) & a.word.eqNullSafe(b.word)
    return a.join(b, same, "left_anti")


def subtree_counts(nodes: DataFrame, deepest: int) -> DataFrame:
    """Adds to internal nodes the number of subtrees that start there: the product over children of (theirs + 1), level by
    level from the deepest: (corpus, sentno, nid, depth, n)."""
    inner = nodes.where(~F.col("is_word")).select("corpus", "sentno", "nid", "parent", "depth")
    done = inner.where(F.col("depth") == deepest).withColumn("n", F.lit(1.0))
    out = done
    for depth in range(deepest - 1, -1, -1):
        up = done.groupBy("corpus", "sentno", F.col("parent").alias("nid")).agg(F.product(F.col("n") + 1).alias("n"))
        done = inner.where(F.col("depth") == depth).join(up, ["corpus", "sentno", "nid"], "left").withColumn("n", F.coalesce("n", F.lit(1.0)))
        out = out.unionByName(done)
    return out.select("corpus", "sentno", "nid", "depth", "n")


def dop_reduction(bnodes: DataFrame) -> DataFrame:
    """The addressed-node expansion of binary nodes (sentno, nid, label, left, right): each production once for every choice
    of plain or addressed labels: (lhs, rhs, n) summed over all nodes; addresses are label@sentno-nid."""
    own = F.concat("label", F.lit("@"), "sentno", F.lit("-"), "nid")
    sides = F.when(F.col("right").contains("|<"), F.array(F.col("right"), F.concat("right", F.lit("@"), "sentno", F.lit("-"), F.col("nid") + 1))).otherwise(F.array("right"))
    x = bnodes.select(F.explode(F.array("label", own)).alias("lhs"), "left", F.explode(F.array(F.lit(0))).alias("z"), sides.alias("sides"))
    x = x.select("lhs", "left", F.explode("sides").alias("right"))
    return x.groupBy("lhs", F.concat_ws(" ", "left", "right").alias("rhs")).agg(F.count("*").alias("n"))


def log_subtrees(nodes: DataFrame) -> DataFrame:
    """For node rows as fragments have them (corpus, sentno, nid, parent, side, depth, label, prod): the same with la, the logarithm of the
    number of fragments that start at the node, and kids, those of its closed children by slot; staged.

    A node has the product over closed children of (theirs + 1); logs do not overflow on large trees. A level of depth is one
    join of children, summed by parent, to their parents.
    """
    from dendrium.operators.staging import once, staged

    nodes = once(nodes)  # read again on each level
    here = ["corpus", "sentno", "nid"]
    none = F.expr("cast(map() as map<int, double>)")
    deepest = nodes.agg(F.max("depth")).first()[0]
    out = below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"kids": none, "la": F.lit(0.0)})
        else:
            kid = below.groupBy("corpus", "sentno", F.col("parent").alias("nid")).agg(
                F.map_from_entries(F.sort_array(F.collect_list(F.struct("side", "la")))).alias("kids"), F.sum(F.col("la") + F.log1p(F.exp(-F.col("la")))).alias("la")
            )
            level = level.join(kid, here, "left").withColumns({"kids": F.coalesce("kids", none), "la": F.coalesce("la", F.lit(0.0))})
        below = staged(level)
        out = below if out is None else out.unionByName(below)
    return out if out is not None else nodes.withColumns({"kids": none, "la": F.lit(0.0)})


def dop_weights(nodes: DataFrame, estimate: str = "relative") -> DataFrame:
    """(lhs, rhs, n, w): the reduction of all fragments of a treebank to rules. Every node gives its production with its own label,
    plain or addressed (label@sentno-nid; sentno must be unique), over its children, each closed one plain or addressed.

    Weights, summed over equal rules: with an addressed lhs, the fragments below the addressed children over those at the node.
    With a plain one, "relative": over those at all nodes with that label; "equal": nodes with the label share evenly, then as
    before; both sum to one for every lhs. "shortest": 0.5 with a plain lhs and 1 with an addressed one, so that a derivation of fewer
    fragments has more weight. Labels are summed up before nodes are joined to them.
    """
    counted = log_subtrees(nodes)
    most = F.max("la")
    total = counted.groupBy("label").agg(most.alias("most"), F.count("*").alias("nodes"))
    mass = counted.join(total, "label").groupBy("label").agg((F.first("most") + F.log(F.sum(F.exp(F.col("la") - F.col("most"))))).alias("mass"), F.first("nodes").alias("nodes"))
    address = lambda label, nid: F.concat(label, F.lit("@"), F.col("sentno").cast("string"), F.lit("-"), nid.cast("string"))
    below = counted.where("parent is not null").groupBy("corpus", "sentno", F.col("parent").alias("nid")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("side", "nid")))).alias("ids"))
    x = counted.join(mass, "label").join(below, ["corpus", "sentno", "nid"], "left").withColumn("over", F.filter(F.split("prod", " "), lambda _, i: i > 0))
    one = F.struct(F.lit("").alias("rhs"), F.lit(0.0).alias("u"))

    def add(so_far, slot):
        label, kid = F.col("over")[slot - 1], F.col("kids")[slot]
        plain = F.transform(so_far, lambda s: F.struct(F.concat_ws(" ", F.nullif(s["rhs"], F.lit("")), label).alias("rhs"), s["u"].alias("u")))
        own = F.transform(so_far, lambda s: F.struct(F.concat_ws(" ", F.nullif(s["rhs"], F.lit("")), address(label, F.col("ids")[slot])).alias("rhs"), (s["u"] + kid).alias("u")))
        return F.when(kid.isNull(), plain).otherwise(F.concat(plain, own))

    x = x.withColumn("sides", F.aggregate(F.sequence(F.lit(1), F.size("over")), F.array(one), add)).select("label", "sentno", "nid", "la", "mass", "nodes", F.inline("sides"))
    inner = F.exp(F.col("u") - F.col("la"))
    plain = {"relative": F.exp(F.col("u") - F.col("mass")), "equal": inner / F.col("nodes"), "shortest": F.lit(0.5)}[estimate]
    both = F.array(F.struct(F.col("label").alias("lhs"), plain.alias("w")), F.struct(address(F.col("label"), F.col("nid")).alias("lhs"), (F.lit(1.0) if estimate == "shortest" else inner).alias("w")))
    rules = x.select("rhs", F.inline(both)).groupBy("lhs", "rhs").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return rules.withColumn("w", F.when(F.col("lhs").contains("@"), 1.0).otherwise(0.5)) if estimate == "shortest" else rules


def markov_threshold(labels: DataFrame, least: int, shorter) -> DataFrame:
    """(label, new): labels seen fewer than `least` times become shorter(label)."""
    seen = labels.groupBy("label").agg(F.count("*").alias("n"))
    return seen.select("label", F.when(F.col("n") < least, shorter(F.col("label"))).otherwise(F.col("label")).alias("new"))


def lexicon_model(tokens: DataFrame, open_tag: int = 50) -> DataFrame:
    """For (word, tag): (tag, n, words, open): tag counts, different lower-cased words, and whether the class is open."""
    return tokens.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct(F.lower("word")).alias("words")).withColumn("open", F.col("words") >= open_tag)


def known_words(tokens: DataFrame, rare: int = 4) -> DataFrame:
    """Words that occur more than `rare` times."""
    return tokens.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > rare)


def replace_rare(tokens: DataFrame, known: DataFrame, signature) -> DataFrame:
    """Adds unk: years are 1970, other numbers 000, known words themselves, and others their signature."""
    k = known.select(F.col("word").alias("k_word"))
    x = tokens.join(k, F.col("word") == F.col("k_word"), "left")
    year, number = F.col("word").rlike("^(19|20)[0-9][0-9]$"), F.col("word").rlike("^[0-9]+(?:[.,][0-9]+)*$")
    return x.withColumn("unk", F.when(year, "1970").when(number, "000").when(F.col("k_word").isNotNull(), F.col("word")).otherwise(signature(F.col("word")))).drop("k_word")


def replaced_counts(counts: DataFrame, signature, rare: int = 4) -> DataFrame:
    """(tag, unk, n) for counted words (tag, word, n): replace_rare() on counts, in one pass. A word's counts by tag meet in a window
    of as many rows as it has tags, and a signature is made once a word and tag, not once a token."""
    seen = counts.withColumn("seen", F.sum("n").over(Window.partitionBy("word")))
    year, number = F.col("word").rlike("^(19|20)[0-9][0-9]$"), F.col("word").rlike("^[0-9]+(?:[.,][0-9]+)*$")
    unk = F.when(year, "1970").when(number, "000").when(F.col("seen") > rare, F.col("word")).otherwise(signature(F.col("word")))
    return seen.groupBy("tag", unk.alias("unk")).agg(F.sum("n").alias("n"))


def replace_unseen(tokens: DataFrame, lexicon: DataFrame, signature) -> DataFrame:
    """Adds unk for words of new text: the word if it is in the lexicon (word), else its lower case, else its signature if that
    is, else _UNK."""
    e = lexicon.select(F.col("word").alias("w1")).distinct()
    x = tokens.withColumn("sig", signature(F.col("word"))).join(e, F.col("word") == F.col("w1"), "left")
    x = x.join(e.withColumnRenamed("w1", "w2"), F.lower("word") == F.col("w2"), "left").join(e.withColumnRenamed("w1", "w3"), F.col("sig") == F.col("w3"), "left")
    return x.withColumn("unk", F.coalesce("w1", "w2", "w3", F.lit("_UNK"))).drop("w1", "w2", "w3", "sig")


def smooth_lexicon(lexicon: DataFrame, rare: DataFrame, mass: float = 0.01) -> DataFrame:
    """(tag, word, n): counts with those of rare words added, and _UNK with a small mass for every tag."""
    every = lexicon.select("tag", "word", F.col("n").cast("double")).union(rare.select("tag", "word", F.col("n").cast("double")))
    unk = lexicon.select("tag").distinct().select("tag", F.lit("_UNK").alias("word"), F.lit(mass).alias("n"))
    return every.union(unk).groupBy("tag", "word").agg(F.sum("n").alias("n"))


def coarse(grammar: DataFrame, pattern: str) -> DataFrame:
    """Labels without what the pattern matches: (label, coarse) for all labels."""
    return grammar.select("lhs").distinct().select(F.col("lhs").alias("label"), F.regexp_replace("lhs", pattern, "").alias("coarse"))


def augment(grammar: DataFrame, more: DataFrame) -> DataFrame:
    """Counts with those of more trees added."""
    return grammar.select("lhs", "rhs", "word", "n").union(more.select("lhs", "rhs", "word", "n")).groupBy("lhs", "rhs", "word").agg(F.sum("n").alias("n"))


def written_rules(weighted: DataFrame) -> DataFrame:
    """Rules as lines of text: lhs, rhs and weight between tabs."""
    return weighted.where(F.col("word").isNull()).select(F.concat_ws("\t", "lhs", F.array_join("rhs", "\t"), F.format_string("%.10g", F.col("p"))).alias("line"))


def written_lexicon(weighted: DataFrame) -> DataFrame:
    """Lexicon as lines of text: a word and its tags with their weights."""
    entry = F.concat_ws(" ", "lhs", F.format_string("%.10g", F.col("p")))
    return weighted.where(F.col("word").isNotNull()).groupBy("word").agg(F.concat_ws("\t", F.first("word"), F.sort_array(F.collect_list(entry))).alias("line")).select("line")
