"""Each operator against brute force on small tables, with nulls, empty texts, ties, repeated rows, no rows, and extra
columns with clashing names."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrium.llm import jaccard_join, language, licenses, mixing, neighbours, packing, quality_classifier, quality_rules, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("size", "shard", "n", "node", "token", "score", "kept", "grp", "place", "target", "words", "doc", "s", "count")


def some_docs(n=120, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        if i % 10 == 3 and i > 10:
            words = rows[i - 5][1].split() if rows[i - 5][1] else ["x"]
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = "\n".join(" ".join(rng.choices(vocab, k=rng.randint(3, 15))) for _ in range(rng.randint(1, 6)))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b", "b", "b"]), len(text)))
    rows += [(n, None, "en", "a", 0), (n + 1, "", None, "b", 0), (n + 2, " \n\t ", "de", None, 3), (n + 3, "Été!", None, None, 4), (n + 4, "word " * 9000, "en", "b", 150000)]
    rows += [rows[0], rows[0], (n + 5, rows[0][1].upper(), "en", "c", 1), (n + 6, rows[1][1], "en", "c", 1), (None, "a lonely text of some words", "en", "b", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(some_docs(), DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


# --- 1


def brute_url(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[3], max(fits)[2]) if fits else (None, "allow"))


def test_urls(spark):
    rules = [*url_filter.RULES, ("com", "/en/7", "block"), ("a.b", "", "block"), ("b", "/x/y", "allow"), ("b", "/x/y", "block"), ("", "/q", "block"), ("net", "de", "allow")]
    urls = [
        None, "", "no scheme", "http://example.com/en/71", "https://WWW.Example.COM/en/7?x=/de/", "http://example.net/de/8/9", "http://x.example.net/de/7", "ftp://org/es/#a", "http://notexample.com/en/1",
        "http://com/en/", "http://a.b", "http://c.a.b/x/y", "http://z.b/x/yy", "http://b/x", "x://y://com/en/", "http://com./en/", "http://example.org?/es/", "http://ÄA.org/es/é",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[3]), (3, urls[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = Counter(map(tuple, url_filter.url_filter(pages, url_filter.rules_frame(spark, rules)).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == Counter((i, *brute_url(u, rules)) for i, u in rows)
    assert url_filter.url_filter(pages.limit(0), url_filter.rules_frame(spark)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, url_filter.rules_frame(spark).limit(0)).collect()} == {"allow"}


def test_url_rules_are_the_contracts(spark):
    """Each rule alone, where no longer one fits, has the contract's word."""
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = spark.createDataFrame([(i, f"http://www.{r}x") for i, r in enumerate(want)], "page_id long, url string")
    # Of the default no verdict may come: every url has a rule.
    got = url_filter.url_filter(pages, url_filter.rules_frame(spark), default="none").collect()
    assert {r.rule: r.verdict for r in got} == want
    assert all(f"('{r.split('/')[0]}', '/{r.split('/', 1)[1]}', '{v}')" in url_filter.OP1_SQL for r, v in want.items())


# --- 2


def test_pieces():
    for n in (1, 2, 3, 4095, 4096, 4097, 9000):
        cut = packing.pieces(n)
        assert sum(x for _, x in cut) == n and all(x & (x - 1) == 0 and x <= 4096 for _, x in cut)
        assert [s for s, _ in cut] == [sum(x for _, x in cut[:i]) for i in range(len(cut))]
    with pytest.raises(ValueError):
        packing.pieces(10, 100)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    extra = docs.sparkSession.createDataFrame([(9000, "a\x1cb <|endoftext|> ABC'S Ñandú's don't 12,5 …", "en", "a", 1), (9001, "e\u0301 ﬁn\u00a0x", "en", "a", 1)], DOCS)
    rows = packing.pack(docs.select("doc_id", "text").union(extra.select("doc_id", "text")), with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    want = Counter()
    for i, text, *_ in [*some_docs(), *extra.collect()]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        for start, length in packing.pieces(len(ids)):
            piece = ids[start : start + length]
            want[(i, start, length, zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids), 0, tuple(piece))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset, tuple(r.ids)) for r in rows) == want
    assert packing.pack(empty).count() == 0


# --- 3


def test_language(spark, docs, empty):
    rng = random.Random(3)
    kinds = {"en": ["the", "and", "with", "house"], "de": ["und", "der", "schön", "haus"], "fr": ["été", "les", "avec", "maison"]}
    rows = [(i, " ".join(rng.choices(kinds[k], k=12)), k, "s", 1) for i, k in enumerate(rng.choices(list(kinds), k=300))]
    rows += [(1000, None, "en", "s", 1), (1001, "123 !!", "en", "s", 1), (1002, "und der", None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    names, matrix = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, names, matrix).collect()}
    assert len(got) == len(rows) and names == ["de", "en", "fr"]
    assert all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 for i in got)
    assert all(got[i].lang_pred == k for i, _, k, *_ in rows[:300])
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "de"
    # the counts against a plain count
    texts = [(t, names.index(k)) for i, t, k, *_ in rows if t and k and not held(i)]
    plain = np.zeros((len(names), language.FEATURES))
    for t, k in texts:
        plain[k] += np.bincount(np.concatenate(language.features([t])[0]), minlength=language.FEATURES)
    plain = plain.T + language.SMOOTHING
    assert np.allclose(matrix, np.log(plain / plain.sum(axis=0)), atol=1e-4)
    # a text's features do not depend on its neighbours
    a, b = language.features(["Ein Haus", "x", "", "the END"]), [language.features([t]) for t in ("Ein Haus", "x", "", "the END")]
    for n in range(len(a[0])):
        assert np.array_equal(a[0][n], np.concatenate([x[0][n] for x in b if len(x[0]) > n]))
    assert language.identify(docs, *language.fit(empty)).where("lang_pred != 'und'").count() == 0
    assert language.identify(empty, names, matrix).count() == 0


# --- 4


def brute_licences(text, model):
    """(line_no, span, family, probability, agreement) of every paragraph that counts; the bound on words is not used."""
    lines = [re.findall("[a-z0-9]+", x.lower()) for x in (text or "").split("\n")]
    windows = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    hits = []
    for span in (1, 2, 3):
        for i in range(len(lines) - span + 1):
            part = lines[i : i + span]
            if not all(part):
                continue
            w = sum(part, [])
            z = model.bias + sum((model.weights[g] for n in (1, 2, 3) for g in windows(w, n) if g in model.weights), np.zeros(len(model.bias)))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            agree = dict.fromkeys(licenses.FAMILIES, 0.0)
            for family, template in licenses.TEMPLATES:
                t, mine = windows(re.findall("[a-z0-9]+", template.lower()), 3), windows(w, 3)
                if t and mine:
                    agree[family] = max(agree[family], len(t & mine) / min(len(t), len(mine)))
            best = max((p[k], agree[f], f) for k, f in enumerate(licenses.FAMILIES))
            family = best[2] if best[0] >= 0.6 and best[1] >= 0.6 else "none" if p.argmax() == len(p) - 1 else "unknown"
            if family != "none":
                hits.append((i, span, family, best[0], best[1]))
    sure = [h for h in hits if h[2] != "unknown"]
    sure = [h for h in sure if not any(s[2] == h[2] and s[1] < h[1] and s[0] >= h[0] and s[0] + s[1] <= h[0] + h[1] for s in sure)]
    covered = {j for h in sure for j in range(h[0], h[0] + h[1])}
    return sure + [h for h in hits if h[2] == "unknown" and h[1] == 1 and h[0] not in covered]


def test_licenses(spark, docs, empty):
    rng = random.Random(5)
    rows = [
        (1, "some text\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0."), (5, "The driver lost a licence plate in the harbour."), (6, "nothing at all"), (7, None), (8, ""), (None, "Released under the MIT License."),
        (9, "Released under the MIT License.\nLicensed under CC BY 4.0.\nLicensed under the Eclipse Public License"), (6, "nothing at all"), (10, "RELEASED UNDER THE MIT LICENSE"), (11, "licen"),
        (12, "word " * 20000 + "licence"), (13, "All rights reserved."), (14, "CC0 1.0 Universal"), (15, "Available under CC BY 4.0"), (13, "All rights reserved."),
        (16, "Redistribution and use in source\nand binary forms, with or without\nmodification, are permitted"), (17, "Released under\n\nthe MIT License"),
    ]
    for i in range(100, 160):  # notices cut into lines at random, among words of notices and of nothing
        words = [w for _ in range(3) for w in (rng.choice(licenses.TEMPLATES)[1] if rng.random() < 0.6 else rng.choice(licenses.OTHERS + licenses.FOREIGN)).split()]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", " ", "\n", "\n \n" if rng.random() < 0.2 else " "]) for w in words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("family", F.lit(1))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {k: v.licence for k, v in got.items() if k is None or k < 100 and k != 9} == {
        1: "mit", 2: "apache", 3: "gpl", 4: "cc-by-nc", 5: "none", 6: "none", 7: "none", 8: "none", None: "mit", 10: "mit", 11: "none", 12: "none", 13: "rights-reserved", 14: "public-domain", 15: "cc-by",
        16: "bsd", 17: got[17].licence,
    }
    assert got[9].licences == ["cc-by", "mit"] and got[9].n_licence_lines == 2 and got[9].n_unknown_lines == 1
    assert got[13].n_licence_lines == 1
    assert licenses.scan(empty).count() == 0
    assert {r.licence for r in licenses.scan(docs).collect()} == {"none"}
    # every paragraph that counts, against a plain computation over all paragraphs
    found, want = {}, {}
    for r in licenses.scan_lines(df).collect():
        found[r.doc_id, r.line_no, r.span, r.family] = (r.probability, r.agreement)
    for doc_id, text in dict(rows).items():
        want |= {(doc_id, *h[:3]): h[3:] for h in brute_licences(text, licenses.train())}
    assert found.keys() == want.keys() and len({k[2] for k in found}) == 3
    assert all(np.allclose(found[k], want[k], atol=1e-9) for k in want)


def test_licences_that_training_does_not_see():
    model = licenses.train()
    sentences = [("apache", "Code under the Apache License, Version 2.0"), ("gpl", "Shared under the GNU General Public License"), ("mit", "Code released under the MIT License, see below"), ("none", "The old mill stood by the river."), ("none", "Prices rose again in the spring.")]
    for family, text in sentences:
        z = model.bias + sum((model.weights[g] for g in licenses._grams(licenses._words(text)) if g in model.weights), np.zeros(len(model.bias)))
        assert licenses.CLASSES[z.argmax()] == family


# --- 5


def brute_rules(text):
    t = text or ""
    w = WORD.findall(t)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_rules(spark, docs, empty):
    rng = random.Random(5)
    clean = [(i, " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 60))), "en", "a", 1) for i in range(1000, 1150)]
    junk = [(i, " ".join("".join(rng.choices("abcde", k=4)) + "###" for _ in range(40)), "en", "a", 1) for i in range(2000, 2010)]
    odd = [(3000, "a b c d e f a b c d e f x y z a b c d e", "en", "a", 1), (3001, "l one\nl one\n \n \nl two " * 3, None, "q", 1)]
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(clean + junk + odd, DOCS)).withColumn("kept", F.lit(1)).withColumn("grp", F.lit(1)).withColumn("m", F.lit(1))
    got = quality_rules.judge(df)
    rows = got.collect()
    want = Counter((i, *brute_rules(t)) for i, t, *_ in [*some_docs(), *clean, *junk, *odd])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept for r in rows if r.base_failed)
    kept = {r.doc_id for r in rows if r.kept}
    assert {i for i, *_ in clean} <= kept and not kept & {i for i, *_ in junk}
    left = quality_rules.keep_good(df)
    assert left.columns == df.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality_rules.judge(empty).count() == 0


def test_distances_are_those_of_the_covariance(spark):
    """The Cholesky factor in columns against numpy."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5)) @ rng.standard_normal((5, 5))
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], ["grp", *quality_rules.Z])
    r = quality_rules._moments(df).first()
    cov = np.cov(x.T, bias=True) + np.diag(np.array(quality_rules.FLOORS) ** 2)
    low = np.linalg.cholesky(cov)
    assert np.allclose(r.l, [low[i, j] for i in range(5) for j in range(i + 1)])
    far = quality_rules._with_estimates(df, quality_rules._moments(df)).select("d2").toPandas().d2.to_numpy()
    d = x - x.mean(axis=0)
    assert np.allclose(sorted(far), sorted(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))


# --- 6


def test_shards(spark, docs, empty):
    t = sharding.tree()
    rows = sharding.assign(docs, t, sharding.grow(t), rows_a_bucket=2).collect()
    source = some_docs()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for i, x, *_ in source)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 24) for r in rows) and all(0 <= r.shard < 24 for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    assert sharding.assign(empty, t).count() == 0


def test_weighted_tree(spark):
    ids = spark.range(30000).withColumnRenamed("id", "doc_id")
    t = {"a": {"k": {0: 1.0, 1: 3.0}}, "b": {"k": {2: 2.0}, "l": {3: 2.0, 4: 0.0}}}
    n = {r.s: r["count"] for r in ids.select(sharding.shard_of(F.col("doc_id"), t).alias("s")).groupBy("s").count().collect()}
    assert set(n) == {0, 1, 2, 3} and all(abs(n[s] / 30000 - w / 8) < 0.015 for s, w in {0: 1, 1: 3, 2: 2, 3: 2}.items())
    changed = {"a": t["a"], "b": {"k": {2: 2.0}, "l": {3: 1.0, 4: 1.0}}}
    moved = ids.select(sharding.shard_of(F.col("doc_id"), t).alias("x"), sharding.shard_of(F.col("doc_id"), changed).alias("y")).where("x != y").distinct().collect()
    assert {(r.x, r.y) for r in moved} == {(3, 4)}  # no other subtree's weight changed
    grown = sharding.grow(sharding.grow(t))
    assert {r.y for r in ids.select(sharding.shard_of(F.col("doc_id"), t).alias("x"), sharding.shard_of(F.col("doc_id"), grown).alias("y")).where("x != y").collect()} == {5, 6}


# --- 7


def brute_classes(rows, words, percent):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[top(i)] = top(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(low.get(top(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), low.get(top(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (2, 50)])
def test_jaccard(docs, empty, words, percent):
    got = Counter(map(tuple, jaccard_join.join(docs, words, percent).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_classes(some_docs(), words, percent)


def test_jaccard_in_a_crowded_group(spark, empty, monkeypatch):
    """Near copies of one text in all distances, with shingles that many nodes share."""
    monkeypatch.setattr(jaccard_join, "CROWDED", 2)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(w[: rng.randint(45, 60)]), "en", "a", 1))
    df = spark.createDataFrame(rows, DOCS)
    for words, percent in ((3, 90), (3, 70)):
        assert Counter(map(tuple, jaccard_join.join(df, words, percent).collect())) == brute_classes(rows, words, percent)
    assert jaccard_join.join(empty).count() == 0


def test_keep_one(docs):
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    want = brute_classes(some_docs(), 5, 80)
    alive = {i for i, n, c in want if n and i == c}
    got = Counter(r.doc_id for r in kept.collect())
    assert {i for i in got if i is not None and i < 120} == {i for i in alive if i is not None and i < 120}
    assert got[0] == 1 and got[None] == 2 and got[120] == 1 and got[121] == 1


# --- 8


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    rows += [(700 + i, rows[50][1]) for i in range(30)]  # copies
    rows += [(800, None), (850, [0.0] * 16), (900, [float("nan")] * 16), (950, [None] + [1.0] * 15), (1000, [1.0] * 4), (None, [1.0] * 16), (1050, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("score", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, every=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and i < 800]
    ids = np.array([i for i, _ in good])
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for q, answers in got.items():
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s.round(12)))[:5]].tolist()
        answers.sort()
        assert [a[0] for a in answers] == [1, 2, 3, 4, 5] and all(abs(a[2] - s[ids == a[1]][0]) < 1e-9 for a in answers)
        hits += len({a[1] for a in answers} & set(best))
        if q in (50, 700, 750) or q == 50:
            assert [a[1] for a in answers] == best
    assert hits >= 0.95 * 5 * len(got)
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2, 50)"), every=50).collect()
    assert len(few) == 6
    assert neighbours.nearest(df.limit(0), every=50).count() == 0


def test_neighbours_in_a_dense_cluster(spark):
    """2,000 near copies of one vector, far closer to each other than 8-bit values can tell, fall into one crowded code."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(16) + 1e-3 * rng.standard_normal((2000, 16)), rng.standard_normal((500, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in neighbours.nearest(df, every=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, answers in got.items():
        far = ((u - u[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(answers & set(np.argsort(far)[:5].tolist()))
    assert len(got) == 50 and hits >= 0.9 * 5 * 50


# --- 9


def test_quality(spark, docs, empty):
    rng = random.Random(9)
    good = [(i, " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(40)) + ".", "en", "a", 1) for i in range(300)]
    bad = [(300 + i, " ".join("".join(rng.choices("ABCDEF", k=4)) + "!!" for _ in range(40)), "en", "a", 1) for i in range(300)]
    df = spark.createDataFrame(good + bad + [(None, None, None, None, None), (601, "", "en", "a", 0)], DOCS).withColumn("score", F.lit("x")).repartition(4)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 600, 2)] + [(1, None, 0), (None, 1, 0), (3, 5, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(df, labels)
    got = {r.doc_id: r for r in quality_classifier.classify(df, model).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(i) for i, r in got.items())
    assert all(got[i].predicted == (i < 300) for i in range(600))
    assert {r.doc_id for r in quality_classifier.keep_good(df, model).collect()} >= set(range(300))
    none = quality_classifier.fit(df, labels.limit(0))
    assert {round(r.score, 6) for r in quality_classifier.classify(docs, none).collect()} == {0.5}
    assert quality_classifier.classify(empty, model).count() == 0


def test_tree_arrays():
    """Flattened traversal against walking each tree by hand; statistics do not depend on the batch."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality_classifier.boost(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.97
    for row, s in zip(x[:50], m.score(x[:50]), strict=True):
        total = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf, strict=True):
            node = 0
            for _ in range(quality_classifier.DEPTH):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - (2**quality_classifier.DEPTH - 1)]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12
    texts = [t for _, t, *_ in some_docs()]
    whole = quality_classifier.statistics(pa.array(texts))
    alone = np.vstack([quality_classifier.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone)
    before = " ".join(f"n{i}" for i in range(10_000))  # word codes of a long neighbour must not make other words alike
    for text in ("n0 n100 n9400 x n1 n1 n90", "n0 n1 n2 n0 n1 n2 n3"):
        both = quality_classifier.statistics(pa.array([before, text]))
        assert np.allclose(both[1], quality_classifier.statistics(pa.array([text]))[0])


def test_repeated_trigrams_against_counting():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "b", "c"] + [f"w{i}" for i in range(k)], k=k)) for k in (1, 2, 3, 9, 40, 300) for _ in range(5)]
    got = quality_classifier.statistics(pa.array(texts))[:, quality_classifier.STATISTICS.index("repeated_trigrams")]
    for text, share in zip(texts, got, strict=True):
        w = text.split()
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        assert abs(share - (sum(seen.values()) - len(seen)) / len(w)) < 1e-12


# --- 10


def test_targets():
    sizes = [("a", 100), ("b", 1000), ("c", 10), (None, 0)]
    t = mixing.targets(sizes)
    assert abs(sum(t) - 1110) < 1e-6 and all(x <= 3 * n + 1e-9 for x, (_, n) in zip(t, sizes, strict=True))
    assert t[2] == 30 and t[3] == 0 and abs(t[0] - 300) < 1e-9
    assert mixing.targets([]) == []


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    source = some_docs()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc.doc_id, r.size) for r in rows) == Counter((i, size(t)) for i, t, *_ in source)
    per = Counter()
    for _, t, _, s, _ in source:
        per[s] += size(t)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([(s, per[s]) for s in order]), strict=True))
    for s in order:
        mine = [r for r in rows if r.doc.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == per[s] for r in mine)
        taken = sum(r.size * r.copies for r in mine)
        assert abs(taken - want[s]) <= max((r.size for r in mine), default=0)
        assert all(0 <= r.copies <= 3 for r in mine)
    again = Counter((r.doc.doc_id, r.size, r.copies) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == Counter((r.doc.doc_id, r.size, r.copies) for r in rows)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_mix_of_repeated_rows(spark, monkeypatch, broadcast):
    """Of rows equal in id and text as many are taken as the target asks for, whichever way the plan is joined."""
    monkeypatch.setattr(mixing, "MOST_BROADCAST", broadcast)
    text = "one two three"
    rows = [(7, text, "en", "a", i % 2) for i in range(400)] + [(i, "a b", "en", "b", 0) for i in range(100, 150)] + [(9, text, "en", None, 0)] * 30
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert len(got) == len(rows) and Counter(r.doc.n_chars for r in got if r.doc.source == "a") == {0: 200, 1: 200}
    for source in ("a", "b", None):
        mine = [r for r in got if r.doc.source == source]
        taken = sum(r.size * r.copies for r in mine)
        assert abs(taken - mine[0].target) <= mine[0].size / 2 + 1e-9 and max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
