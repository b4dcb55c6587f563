"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of a text, or 2 to SPAN lines in a row that all have a word, read as one (notices are wrapped).
A multinomial logistic regression over word 1- to 3-grams gives its probability for each licence family, for
"unknown" (a notice of another licence) and for "none" (ordinary text). It is trained on the driver from the sentences
below, whole and shortened; proximal steps keep its weights sparse, and a temperature, fitted on sentences that
training does not see, calibrates it. A family is reported if its probability is at least CONFIDENT and the paragraph's
word 3-grams agree with a template of that family; other paragraphs that are not likeliest "none" are unknown.

Every paragraph counts, but most need no arithmetic: without words that can raise a class above "none" by enough
in all, the regression gives "none". That bound is computed from the weights (see `Model.words`), so it changes no
verdict. The model is a table of n-grams with their weights, of fixed size; the other paragraphs meet it in a join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.llm.common import table, written

#: The notices of each family.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("rights-reserved", "All rights reserved."),
)
OTHERS = (
    "The driver lost a licence after the second offence.", "A fishing licence is needed on this river.", "Software vendors charge licence fees for every seat.",
    "The band released a second album under another name.", "Her photographs are in the public domain.", "The court found that the licence had expired.",
    "You need a licence to sell wine in this town.", "All licensed doctors must register each year.", "The pub was licensed under the old act of 1904.",
    "Version 3 of this work is for the general public.", "The restaurant is licensed and open until two.", "They license their patents to other firms.",
    "Creative commons of the mind was the title of the lecture.", "The permission is hereby withdrawn, wrote the mayor.", "Driving without a licence is an offence under the law.",
    "The public domain grows each January.", "Poetic licence explains the odd dates.", "The licence plate was found near the lake.",
)
#: Notices of licences that are no family, and sentences that training does not see.
FOREIGN = (
    "Licensed under the Eclipse Public License, version 2.0.", "Released under the zlib License.", "Distributed under the Boost Software License, Version 1.0.",
    "This file is licensed under the European Union Public Licence.", "Use of this software is governed by the Business Source License.", "Licensed under the Artistic License.",
    "Released under the ISC License.", "The use of this material is subject to the terms of a commercial licence.", "This software is proprietary and may not be redistributed.",
    "Licensed under the Open Database License.", "See the LICENSE file for the terms of use.", "This font is licensed under the SIL Open Font License.",
)
HELD = (
    ("apache", "Available under the Apache License 2.0"), ("apache", "This project is licensed under the Apache License, Version 2.0"),
    ("mit", "This project is released under the MIT License"), ("mit", "MIT License"),
    ("gpl", "Licensed under the GNU General Public License"), ("gpl", "You can redistribute it under the terms of the GNU General Public License version 3"),
    ("cc-by-nc", "Available under CC BY-NC 4.0"), ("cc-by-nc", "Text licensed under CC BY-NC 4.0 by its authors"),
    ("cc-by", "Available under CC BY 4.0"), ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("bsd", "Distributed under the BSD 3-Clause License"), ("mpl", "Subject to the terms of the Mozilla Public License"),
    ("public-domain", "Released into the public domain"), ("rights-reserved", "Copyright by the publisher. All rights reserved."),
    ("unknown", "Released under the Eclipse Public License"), ("unknown", "Licensed under the University of Illinois License"), ("unknown", "Distributed under a commercial licence"),
    ("unknown", "Licensed under the Academic Free License"), ("none", "The licence to hunt costs nine euros a year."), ("none", "Two members of the public asked about the terms."),
    ("none", "He was released after the second version of events was heard."), ("none", "A table for four was reserved at the inn."), ("none", "The work of the committee is subject to review."),
    ("none", "Her rights under the contract were reserved by the court."), ("none", "Free software is the subject of the third chapter."), ("none", "They met in the street and talked about the weather."),
)
#: Words that say nothing of licences: an n-gram of nothing else is no feature.
PLAIN = frozenset("a all an and any are as at be by can do for from following full in is it not of on or may out provided see that the this to under whom with without you your".split())
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
UNKNOWN, NONE = "unknown", "none"
CLASSES = (*FAMILIES, UNKNOWN, NONE)
ORDER, SPAN, CONFIDENT, AGREES = 3, 3, 0.6, 0.6


@dataclass(frozen=True)
class Model:
    """weights: a row per n-gram in order of CLASSES; bias likewise; words: how much a word can at most add to the lead
    of any class over "none", with all n-grams that are counted to it; gap: the lead of "none" without n-grams."""

    weights: dict[str, np.ndarray]
    bias: np.ndarray
    words: dict[str, float]
    gap: float


def _words(line: str) -> list[str]:
    return re.findall("[a-z0-9]+", line.lower())


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, ORDER + 1) for i in range(len(words) - n + 1) if not PLAIN.issuperset(words[i : i + n])}


def _threes(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + ORDER]) for i in range(len(words) - ORDER + 1)}


def _examples() -> list[tuple[list[str], str]]:
    """Templates and others whole and with each word left out; notices also inside other words."""
    out = []
    for family, line in [*TEMPLATES, *((UNKNOWN, o) for o in FOREIGN), *((NONE, o) for o in OTHERS)]:
        w = _words(line)
        out += [(v, family) for v in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)) if len(w) > ORDER)]]
        out += [] if family == NONE else [(["note", "that"] + w, family), (w + ["see", "the", "file"], family)]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _matrix(texts: list[list[str]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary)))
    for r, w in enumerate(texts):
        x[r, [vocabulary[g] for g in _grams(w) if g in vocabulary]] = 1
    return x


@lru_cache(maxsize=1)
def train(steps: int = 400, rate: float = 0.5, lasso: float = 2e-4) -> Model:
    """The same model in every run: proximal gradient steps from zero, then the temperature with the least loss on HELD."""
    examples = _examples()
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(_grams(w) for w, _ in examples))))}
    x, y = _matrix([w for w, _ in examples], vocabulary), np.eye(len(CLASSES))[[CLASSES.index(f) for _, f in examples]]
    share = (1 / y.sum(axis=0))[y.argmax(axis=1)][:, None] / len(CLASSES)
    w, b = np.zeros((len(vocabulary), len(CLASSES))), np.zeros(len(CLASSES))
    b[-1] = 2.0  # a paragraph without known n-grams is none, by this much
    for _ in range(steps):
        w -= rate * (x.T @ ((_softmax(x @ w + b) - y) * share))
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
    held, truth = _matrix([_words(t) for _, t in HELD], vocabulary), [CLASSES.index(f) for f, _ in HELD]
    loss = lambda t: -np.log(_softmax((held @ w + b) / t)[np.arange(len(truth)), truth] + 1e-300).mean()
    t = min((k / 20 for k in range(2, 61)), key=loss)
    w, b = w / t, b / t
    lead = np.maximum(w[:, :-1] - w[:, -1:], 0).max(axis=1)
    own = {g: lead[i] for g, i in vocabulary.items() if " " not in g}
    words: dict[str, float] = {}
    for g, i in vocabulary.items():
        if lead[i] > 0:  # counted to its most telling word; one of them is not plain
            word = max((v for v in g.split() if v not in PLAIN), key=lambda v: (own.get(v, 0.0), v))
            words[word] = words.get(word, 0.0) + float(lead[i])
    used = {g: w[i] for g, i in vocabulary.items() if w[i].any()}
    return Model(used, b, words, float(b[-1] - b[:-1].max()))


def _table(spark: SparkSession) -> DataFrame:
    """The n-grams with weights or in a template's 3-grams."""
    model, threes = train(), [_threes(_words(t)) for _, t in TEMPLATES]
    rows = [(g, [float(v) for v in model.weights.get(g, np.zeros(len(CLASSES)))], [i for i, t in enumerate(threes) if g in t]) for g in sorted(set(model.weights).union(*threes))]
    return spark.createDataFrame(rows, "gram string, weights array<double>, templates array<int>")


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _paragraphs(text: Column) -> Column:
    """The paragraphs of a text (line_no, span, line: their words) that may be other than "none"."""
    model = train()
    known = list(model.words)
    bounds = F.create_map(*[F.lit(v) for pair in model.words.items() for v in pair])
    bound = lambda w: F.aggregate(F.array_distinct(w), F.lit(1e-9), lambda a, v: a + F.element_at(bounds, v))
    words = lambda line: F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")
    lines = F.transform(F.split(text, "\n"), lambda x: _let(words(x), lambda w: F.struct(w.alias("w"), F.filter(w, lambda v: v.isin(known)).alias("k"))))

    def at(ls: Column, i: Column, span: int) -> Column:
        part = [F.get(ls, i + k) for k in range(span)]
        fits = reduce(and_, [F.coalesce(F.size(p["w"]) > 0, F.lit(False)) for p in part])
        telling = reduce(or_, [F.size(p["k"]) > 0 for p in part]) & (bound(F.concat(*[p["k"] for p in part])) >= model.gap)
        return F.when(fits & telling, F.struct(i.alias("line_no"), F.lit(span).alias("span"), F.array_join(F.concat(*[p["w"] for p in part]), " ").alias("line")))

    return _let(lines, lambda ls: F.filter(F.flatten(F.transform(ls, lambda _, i: F.array(*[at(ls, i, s) for s in range(1, SPAN + 1)]))), lambda p: p.isNotNull()))


def judge_lines(lines: DataFrame, key: list[str]) -> DataFrame:
    """For paragraphs (key, line: words in lower case with one space between): key, family, probability, agreement."""
    bias = train().bias
    sizes = [len(_threes(_words(t))) for _, t in TEMPLATES]

    def gram(w: Column, n: int) -> Column:  # by element: a slice of a long array takes time by its length
        parts = lambda i: [p for k in range(n) for p in (F.lit(" "), F.get(w, i + k))][1:]
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat(*parts(i)))).otherwise(F.array().cast("array<string>"))

    every = _let(F.split("line", " "), lambda w: F.array_distinct(F.concat(*[gram(w, n) for n in range(1, ORDER + 1)])))
    grams = lines.select(*key, F.explode_outer(every).alias("gram")).withColumn("three", F.size(F.split("gram", " ")) == ORDER)
    sums = grams.join(F.broadcast(_table(lines.sparkSession)), "gram", "left").groupBy(*key).agg(
        F.sum(F.col("three").cast("int")).alias("n"), F.array(*[F.coalesce(F.sum(F.col("weights")[k]), F.lit(0.0)) + float(bias[k]) for k in range(len(CLASSES))]).alias("z"),
        F.array(*[F.sum(F.coalesce(F.array_contains("templates", i), F.lit(False)).cast("int")) for i in range(len(TEMPLATES))]).alias("t"),
    )
    odds = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
    p = _let(odds, lambda o: F.transform(o, lambda v: v / F.aggregate(o, F.lit(0.0), lambda a, x: a + x)))
    size, of = F.array(*map(F.lit, sizes)), F.array(*[F.lit(FAMILIES.index(f)) for f, _ in TEMPLATES])
    agree = F.transform("t", lambda v, i: F.when((F.col("n") > 0) & (F.get(size, i) > 0), v / F.least(F.col("n"), F.get(size, i))).otherwise(0.0))
    names = F.array(*map(F.lit, FAMILIES))

    def best(p: Column, a: Column) -> Column:
        within = lambda f: F.array_max(F.transform(a, lambda v, i: F.when(F.get(of, i) == f, v).otherwise(0.0)))
        return F.array_max(F.transform(names, lambda name, f: F.struct(F.get(p, f).alias("p"), within(f).alias("agreement"), name.alias("family"))))

    out = sums.select(*key, _let(p, lambda p: _let(agree, lambda a: F.struct(best(p, a).alias("b"), (F.get(p, F.lit(len(CLASSES) - 1)) >= F.array_max(p)).alias("none")))).alias("r")).select(*key, "r.*")
    sure = (F.col("b.p") >= CONFIDENT) & (F.col("b.agreement") >= AGREES)
    family = F.when(sure, F.col("b.family")).when(F.col("none"), NONE).otherwise(UNKNOWN)
    return out.select(*key, family.alias("family"), F.col("b.p").alias("probability"), F.col("b.agreement").alias("agreement"))


def scan_lines(docs: DataFrame) -> DataFrame:
    """Returns doc_id, text_hash, line_no (from 0), span (lines), family, probability and agreement for each paragraph of
    docs that is not "none"; equal rows count once. A longer paragraph counts only if it is confirmed and none within it
    is confirmed for the same family; a line is unknown only outside of confirmed paragraphs."""
    # explode_outer: for explode, Spark adds a filter that computes its input a second time
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode_outer(_paragraphs(F.col("text"))).alias("e")).where("e is not null").select("doc_id", "text_hash", "e.*")
    return _settled(judge_lines(written(found.distinct()), ["doc_id", "text_hash", "line_no", "span"]))


def _settled(judged: DataFrame) -> DataFrame:
    hit = F.struct("line_no", "span", "family", "probability", "agreement")
    texts = judged.where(F.col("family") != NONE).groupBy("doc_id", "text_hash").agg(F.collect_list(hit).alias("hits"))
    sure = F.filter("hits", lambda h: h["family"] != UNKNOWN)
    inner = lambda h, s: (s["family"] == h["family"]) & (s["span"] < h["span"]) & (s["line_no"] >= h["line_no"]) & (s["line_no"] + s["span"] <= h["line_no"] + h["span"])
    texts = texts.select("*", F.filter(sure, lambda h: ~F.exists(sure, lambda s: inner(h, s))).alias("sure"))
    covered = F.flatten(F.transform("sure", lambda s: F.sequence(s["line_no"], s["line_no"] + s["span"] - 1)))
    texts = texts.select("*", covered.alias("covered"))
    rest = F.filter("hits", lambda h: (h["family"] == UNKNOWN) & (h["span"] == 1) & ~F.array_contains("covered", h["line_no"]))
    return texts.select("doc_id", "text_hash", F.explode(F.concat("sure", rest)).alias("h")).select("doc_id", "text_hash", "h.*")


def scan(docs: DataFrame) -> DataFrame:
    """Returns doc_id, licence, licences, n_licence_lines, n_unknown_lines and probability for each id of docs.

    licence is the confirmed family with the highest probability ('unknown' if there are only notices that none
    confirms, 'none' without any), licences all confirmed families in order; n_licence_lines counts confirmed paragraphs.
    Rows that repeat an id are one document, equal rows count once; a null text has no lines; a null id is an id; a
    line may be as long as a text. No rows give no rows; columns besides doc_id and text are not looked at.
    """
    docs = docs.select("doc_id", "text")
    lines = scan_lines(docs).select("doc_id", F.struct((F.col("family") != UNKNOWN).alias("sure"), "probability", "family").alias("hit"))
    every = docs.select("doc_id", F.lit(None).cast(lines.schema["hit"].dataType).alias("hit"))
    sure = F.col("hit.sure")
    out = every.union(lines).groupBy("doc_id").agg(
        F.max(F.when(sure, F.col("hit"))).alias("best"), F.sort_array(F.collect_set(F.when(sure, F.col("hit.family")))).alias("licences"),
        F.sum(F.when(sure, 1).otherwise(0)).alias("n_licence_lines"), F.sum(F.when(~sure, 1).otherwise(0)).alias("n_unknown_lines"),
    )
    named = F.when(F.col("n_licence_lines") > 0, F.col("best.family")).when(F.col("n_unknown_lines") > 0, UNKNOWN).otherwise(NONE)
    return out.select("doc_id", named.alias("licence"), "licences", "n_licence_lines", "n_unknown_lines", F.coalesce("best.probability", F.lit(0.0)).alias("probability"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
