"""Evaluation: multisets of labelled brackets, precision, recall, F, and what is broken down from them. An undefined
score is null."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from dendrium.operators import batches

SENTENCE = ["corpus", "sentno"]
NODE = [*SENTENCE, "nid"]


def fanout(leaves: Column) -> Column:
    """The number of gapless runs of leaves (in ascending order)."""
    return F.size(F.filter(F.transform(leaves, lambda x, i: F.when(i == 0, True).otherwise(x - leaves[i - 1] > 1)), lambda starts: starts))


def paired(gold: DataFrame, candidate: DataFrame, sentence: tuple[str, ...] = ("sentno",)) -> DataFrame:
    """(sentence, label, leaves, g, c): how often each bracket is in gold and candidate."""
    key = [*sentence, "label", "leaves"]
    g, c = gold.groupBy(*key).agg(F.count("*").alias("g")), candidate.groupBy(*key).agg(F.count("*").alias("c"))
    return g.join(c, key, "full").select(*key, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("c", F.lit(0)).alias("c"))


def _scores(m: Column, g: Column, c: Column) -> list[Column]:
    p, r = F.when(c > 0, m / c), F.when(g > 0, m / g)
    f = F.when((p > 0) & (r > 0), 2 * p * r / (p + r))
    return [m.alias("matching"), g.alias("gold"), c.alias("candidate"), F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f, 9).alias("f")]


def _sums() -> tuple[Column, Column, Column]:
    return F.sum(F.least("g", "c")), F.sum("g"), F.sum("c")


def summary(pairs: DataFrame, *by: str) -> DataFrame:
    """Matching, gold and candidate brackets with precision, recall and F, over all or by columns."""
    m, g, c = _sums()
    x = pairs.groupBy(*by).agg(m.alias("m"), g.alias("gg"), c.alias("cc"))
    return x.select(*by, *_scores(F.col("m"), F.col("gg"), F.col("cc")))


def exact(pairs: DataFrame, gold: DataFrame | None = None, candidate: DataFrame | None = None) -> DataFrame:
    """(sentences, parsed, exact): sentences of gold, those with a candidate, and those with equal brackets. Without gold and candidate
    they are the sentences with brackets in pairs, which are gone through once."""
    if gold is None or candidate is None:
        per = pairs.groupBy("sentno").agg(F.bool_and(F.col("g") == F.col("c")).alias("same"), F.max(F.col("g") > 0).alias("in_gold"), F.max(F.col("c") > 0).alias("parsed"))
        return per.where("in_gold").agg(F.count("*").alias("sentences"), F.sum(F.col("parsed").cast("int")).alias("parsed"), F.sum(F.col("same").cast("int")).alias("exact"))
    same = pairs.groupBy("sentno").agg(F.bool_and(F.col("g") == F.col("c")).alias("same"))
    parsed = candidate.select("sentno").distinct().withColumn("parsed", F.lit(1))
    return gold.select("sentno").distinct().join(same, "sentno", "left").join(parsed, "sentno", "left").agg(
        F.count("*").alias("sentences"), F.sum(F.coalesce("parsed", F.lit(0))).alias("parsed"), F.sum(F.coalesce("same", F.lit(False)).cast("int")).alias("exact")
    )


def discontinuous(pairs: DataFrame) -> DataFrame:
    return pairs.where(fanout(F.col("leaves")) > 1)


def confusions(gold: DataFrame, candidate: DataFrame, most: int = 10) -> DataFrame:
    """(gold, candidate, n): labels of equal leaves that differ, the most frequent ones."""
    g, c = gold.select("sentno", "leaves", F.col("label").alias("gold")), candidate.select("sentno", "leaves", F.col("label").alias("candidate"))
    x = g.join(c, ["sentno", "leaves"]).where("gold != candidate").groupBy("gold", "candidate").agg(F.count("*").alias("n"))
    return x.orderBy(F.desc("n"), "gold", "candidate").limit(most)


def tag_accuracy(gold: DataFrame, candidate: DataFrame) -> DataFrame:
    """(n, right, accuracy) for (sentno, pos, tag). A position that only one side has is wrong."""
    x = gold.join(candidate.select("sentno", "pos", F.col("tag").alias("other")), ["sentno", "pos"], "full")
    return x.agg(F.count("*").alias("n"), F.sum(F.coalesce((F.col("tag") == F.col("other")).cast("long"), F.lit(0))).alias("right")).withColumn("accuracy", F.round(F.col("right") / F.col("n"), 9))


# --- evaluation with parameters, on node rows: corpus, sentno, nid, parent, depth, label, pos (the number of its word, for a node
# over one word, else null), word


def parameters(text: str) -> dict:
    """A parameter file: a key and its value a line, "#" starts a remark. Labels or words that are declared equal, directly or
    over others, are mapped to the least of them."""
    out: dict = {"CUTOFF_LEN": 40, "LABELED": 1, "DISC_ONLY": 0, "DELETE_ROOT_PRETERMS": 0, "DEBUG": 0, "MAX_ERROR": 10, "LA": 0, "TED": 0, "DEP": 0}
    sets: dict = {"DELETE_LABEL": set(), "DELETE_WORD": set(), "DELETE_LABEL_FOR_LENGTH": set()}
    equal: dict = {"EQ_LABEL": {}, "EQ_WORD": {}}
    seen = set()
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        key, _, value = line.strip().partition(" ")
        value = value.strip()
        if key in out:
            if key in seen:
                raise ValueError(f"{key} is declared twice")
            seen.add(key)
            out[key] = int(value)
        elif key in sets:
            sets[key].add(value)
        elif key in equal:
            if len(value.split()) != 2:
                raise ValueError(f"{key} needs two values: {line!r}")
            groups = equal[key]
            both = set().union(*(groups.get(v, {v}) for v in value.split()))
            groups.update(dict.fromkeys(both, both))
        else:
            raise ValueError(f"no such parameter: {key}")
    return out | sets | {k: {x: min(g) for x, g in groups.items()} for k, groups in equal.items()}


def _mapped(c: Column, to: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in to.items() for x in pair])[c], c) if to else c


def _is_in(c: Column, values: set[str]) -> Column:
    return c.isin(*values) if values else F.lit(False)


def _both(gold: DataFrame, candidate: DataFrame, params: dict) -> DataFrame:
    """The nodes of both, with what the parameters say of each: _gone (a word, or a phrase, that is removed), _counts (for the length), _label and _word (as compared)."""
    tag, word = F.col("label"), F.col("word")
    gone = _is_in(tag, params["DELETE_LABEL"]) | _is_in(word, params["DELETE_WORD"])
    if params["DELETE_ROOT_PRETERMS"]:
        gone = gone | (F.col("depth") == 1)
    label = F.when(F.col("parent").isNull(), tag).otherwise(_mapped(tag, params["EQ_LABEL"]))
    is_word = F.col("pos").isNotNull()
    new = {
        "_gone": F.coalesce(F.when(is_word, gone).otherwise(_is_in(label, params["DELETE_LABEL"])), F.lit(True)), "_counts": F.coalesce(~_is_in(tag, params["DELETE_LABEL_FOR_LENGTH"]), F.lit(False)),
        "_label": F.when(is_word, tag).otherwise(label if params["LABELED"] else F.lit("")), "_word": _mapped(word, params["EQ_WORD"]),
    }
    side = lambda df, is_gold: df.where("sentno is not null and nid is not null").select(*NODE, "parent", "pos", *[c.alias(k) for k, c in new.items()], F.lit(is_gold).alias("_gold"))
    return side(gold, True).unionByName(side(candidate, False))


def _leaves(t: batches.Trees, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every node over phrases with the numbers of its words, ascending by row; words without one (-1) are left out."""
    batches.ends(t.up)  # parents in a circle are found before they are followed
    at = np.flatnonzero(t.over_word & (number >= 0))
    n, rows, numbers = number[at], [], []
    while len(at):
        above = t.up[at]
        at, n = above[above >= 0], n[above >= 0]
        on = ~t.over_word[at]
        at, n = at[on], n[on]
        rows.append(at)
        numbers.append(n)
    rows, numbers = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, numbers))
    order = np.lexsort((numbers, rows))
    return rows[order], numbers[order]


def _matches(sent: np.ndarray, label: np.ndarray, is_gold: np.ndarray, rows: np.ndarray, numbers: np.ndarray, kept: Callable) -> tuple[np.ndarray, ...]:
    """(sent, gold, candidate) for the different brackets: how often each is there. Brackets of the same size are compared number by number."""
    first = np.flatnonzero(np.r_[np.ones(min(1, len(rows)), bool), rows[1:] != rows[:-1]])
    size = np.diff(np.r_[first, len(rows)])
    out = []
    for k in np.unique(size):
        begin = first[size == k]
        leaves = numbers[begin[:, None] + np.arange(k)]
        begin, leaves = (x[kept(rows[begin], leaves)] for x in (begin, leaves))
        if not len(begin):
            continue
        of = rows[begin]
        keys = [*leaves.T, label[of], sent[of]]
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        for key in keys:
            new |= np.r_[True, key[order][1:] != key[order][:-1]]
        which = np.cumsum(new) - 1
        g = np.bincount(which, weights=is_gold[of][order]).astype(np.int64)
        out.append((sent[of][order][new], g, np.bincount(which) - g))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def by_sentence(gold: DataFrame, candidate: DataFrame, params: dict) -> DataFrame:
    """(corpus, sentno, length, words, parsed, same_words, matching, gold, candidate, precision, recall, f, exact, tags_right) for every
    sentence of gold; words, tags and brackets after removals, length by the words that count for it. A sentence without candidate matches nothing.
    same_words tells whether both have the same words (equal ones count as the same); words that only one has are never right.

    Both trees of a sentence meet once; brackets are gathered and compared there, exactly, for many sentences at once."""
    disc = bool(params["DISC_ONLY"])
    counts = ["length", "words", "parsed", "same_words", "m", "gg", "cc", "same", "tags_right"]
    truths = ("parsed", "same_words", "same")

    def run(table: pa.Table, sent: np.ndarray) -> pa.Table:
        n = int(sent[-1]) + 1 if len(sent) else 0
        label, word, is_gold = batches.codes(table["_label"]), batches.codes(table["_word"]), batches.flags(table["_gold"])
        gone, counted = batches.flags(table["_gone"]), batches.flags(table["_counts"])
        trees = {side: batches.Trees(table.select(["nid", "parent", "pos"]).filter(pa.array(is_gold == side)), sent[is_gold == side]) for side in (True, False)}
        rows_of = {side: np.flatnonzero(is_gold == side) for side in trees}
        g, c = trees[True], trees[False]
        words = np.flatnonzero(g.over_word)
        words = words[np.lexsort((g.pos[words], g.sent[words]))]
        places = batches.Places(g.sent[words], g.pos[words])
        stay = ~gone[rows_of[True][words]]
        # The words that stay are counted from 0 in their sentence.
        before = np.cumsum(stay) - stay
        new = np.where(stay, before - before[np.searchsorted(g.sent[words], g.sent[words])], -1) if len(words) else words
        number = {True: np.full(len(g.sent), -1)}
        number[True][words] = new
        at = places.at(c.sent, c.pos, c.over_word)
        number[False] = np.where(at >= 0, new[at], -1) if len(words) else np.full(len(c.sent), -1)
        rows, numbers = [], []
        for side, t in trees.items():
            r, x = _leaves(t, number[side])
            rows.append(rows_of[side][r])
            numbers.append(x)
        kept = lambda row, leaves: ~gone[row] & (leaves[:, -1] - leaves[:, 0] >= leaves.shape[1] if disc else True)
        of, in_gold, in_other = _matches(sent, label, is_gold, np.concatenate(rows), np.concatenate(numbers), kept)
        sums = lambda where, by: np.bincount(where, weights=by, minlength=n).astype(np.int64)
        here, other = words[at[at >= 0]], np.flatnonzero(at >= 0)
        grow, crow = rows_of[True][here], rows_of[False][other]
        alike = (word[grow] == word[crow]) & (word[grow] >= 0)
        right = (new[at[other]] >= 0 if len(words) else np.zeros(0, bool)) & (label[grow] == label[crow]) & (label[grow] >= 0)
        both_words = np.bincount(c.sent[other][alike], minlength=n)
        all_words = np.bincount(g.sent[words], minlength=n) + np.bincount(c.sent[c.over_word], minlength=n) - np.bincount(c.sent[other], minlength=n)
        tagged = label[rows_of[False]] >= 0
        found = {
            "length": sums(g.sent[words], counted[rows_of[True][words]]), "words": sums(g.sent[words], stay), "parsed": np.bincount(c.sent[c.over_word & tagged], minlength=n) > 0, "same_words": both_words == all_words,
            "m": sums(of, np.minimum(in_gold, in_other)), "gg": sums(of, in_gold), "cc": sums(of, in_other), "same": np.bincount(of[in_gold != in_other], minlength=n) == 0, "tags_right": np.bincount(c.sent[other][right], minlength=n),
        }
        some = np.flatnonzero(np.bincount(g.sent[words], weights=label[rows_of[True][words]] >= 0, minlength=n) > 0)
        first = np.flatnonzero(np.r_[np.ones(min(1, len(sent)), bool), sent[1:] != sent[:-1]])
        out = table.select(SENTENCE).take(pa.array(first[some]))
        for k in counts:
            out = out.append_column(k, pa.array(found[k][some]))
        return out

    both = _both(gold, candidate, params)
    kinds = {f.name: f for f in both.schema}
    schema = StructType([*[kinds[k] for k in SENTENCE], *[StructField(k, BooleanType() if k in truths else LongType()) for k in counts]])
    x = batches.by_sentence(both, run, schema, ("_gold", "nid"))
    return x.select(*SENTENCE, "length", "words", "parsed", "same_words", *_scores(F.col("m"), F.col("gg"), F.col("cc")), (F.col("parsed") & F.col("same")).alias("exact"), "tags_right")


def totals(sentences: DataFrame, params: dict) -> DataFrame:
    """(scope, sentences, parsed, exact, matching, gold, candidate, precision, recall, f, mean_f, tag_accuracy) over all sentences, and
    over those of at most CUTOFF_LEN words. mean_f is the mean of the sentences that have an F."""
    scope = F.when(F.col("length") <= params["CUTOFF_LEN"], F.array(F.lit("all"), F.lit("cutoff"))).otherwise(F.array(F.lit("all")))
    x = sentences.withColumn("scope", F.explode(scope)).groupBy("scope").agg(
        F.count("*").alias("sentences"), F.count_if("parsed").alias("parsed"), F.count_if("exact").alias("exact"), *[F.sum(k).alias(f"n_{k}") for k in ("matching", "gold", "candidate")],
        F.round(F.avg("f"), 9).alias("mean_f"), F.sum("tags_right").alias("t"), F.sum("words").alias("w"),
    )
    return x.select("scope", "sentences", "parsed", "exact", *_scores(F.col("n_matching"), F.col("n_gold"), F.col("n_candidate")), "mean_f", F.when(F.col("w") > 0, F.round(F.col("t") / F.col("w"), 9)).alias("tag_accuracy"))
