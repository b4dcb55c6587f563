"""Token files, session versions and the filter audit against brute force: nulls, empty and long texts, repeated rows, ties,
no rows, extra columns with clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrium.llm import filter_audit, sessions, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string"
CLASH = ("part", "number", "place", "value", "segment", "k1", "k2", "mask", "digest", "first", "n", "user", "batch", "x", "side", "start", "death", "up")


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def odd_texts():
    rng = random.Random(5)
    parts = ["word", "Über", "don't", "l'été", "12,5", " ", "  ", "\n", "\t\n", "  ", "　", "\u0085", "\x1c", "\x7f", "é", "日本", "!?", "😀", "<|endoftext|>", "-", "'s", "\r\n", "\x0b"]
    out = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(150)]
    return [*out, "", None, " ", "\n\n", "a" * 3000, "ab cd " * 30000]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [(7 * i % 211 - 20, t, ["en", "de", "", None][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[3]] * 4 + [(rows[5][0], "another text with that id", "en"), (None, "no id", "de"), (None, None, None), (1000, rows[8][1], "en"), (1001, rows[8][1], "fr")]
    return clashing(spark.createDataFrame(rows, DOCS)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return clashing(spark.createDataFrame([], DOCS))


# --- 11


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("top", [1, 2, 50257, 2**32])
def test_blocks(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    ids[rng.random(n) < 0.95] %= 300
    packed = token_files.pack_blocks(ids)
    assert (token_files.unpack_blocks(*packed, n) == ids).all()
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2))
        assert (token_files.unpack_blocks(*packed, n, a, b) == ids[a:b]).all()
    if n == 5000 and top == 50257:
        assert len(packed[4]) and len(packed[6]) < 1.3 * n  # most ids take nine bits, the others are exceptions


def test_segments_are_checked():
    raw = token_files.segment(1, 2, [5, None], [2, 1], np.array([9, 0, 0], np.uint32))
    two = list(token_files.segments(raw + b"\n" + raw + b"\n"))
    assert [s.ids().tolist() for s in two] == [[9, 0, 0]] * 2 and two[1].null.tolist() == [0, 1]
    with pytest.raises(ValueError):
        list(token_files.segments(raw[:-1]))
    with pytest.raises(ValueError):
        list(token_files.segments(b"x" + raw))


def test_chunks_give_the_ids_of_whole_texts():
    import pyarrow as pa

    encoder = token_files.Encoder(token_files.default_tokenizer(), kept=200)
    for texts in (odd_texts(), ["", None], [], ["x"]):
        ids, ends = encoder.encode(pa.array(texts, pa.string()))
        for text, a, b in zip(texts, [0, *ends], ends, strict=False):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_files(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENTS_A_FILE", 2)
    monkeypatch.setattr(token_files, "SEGMENT", 2000)
    monkeypatch.setattr(token_files, "SLICE_CHARS", 1000)
    path = str(tmp_path / "files")
    token_files.write(docs, path)
    encode = token_files.Encoder(token_files.default_tokenizer()).tokenizer.encode
    want = [(r.doc_id, encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    digest = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    got = sorted(token_files.documents(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, *digest(ids)) for d, ids in want)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
    full = token_files.read(spark, path, with_ids=True).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in full) == Counter((d, tuple(ids)) for d, ids in want)
    found = token_files.index(spark, path).collect()
    assert sum(r.n for r in found) == sum(len(i) for _, i in want) and sum(r.documents for r in found) == len(want)
    assert len(found) > 2
    one = max(found, key=lambda r: r.base)
    raw = open(one.path.removeprefix("file:"), "rb").read()
    s = token_files.Segment(raw, one.at)
    last = got[-1]
    assert digest(s.ids(last.start - one.base).tolist()) == (last.n_tokens, last.ids_crc32)
    nothing = str(tmp_path / "nothing")
    token_files.write(empty, nothing)
    assert token_files.documents(spark, nothing).count() == 0


# --- 12


def brute_versions(events, gap):
    """Sessions are formed anew after each batch."""
    by = defaultdict(list)
    for user, at, batch, amount in events:
        if None not in (user, at, batch):
            by[user].append((at, batch, amount or 0))
    out = {}
    for user, rows in by.items():
        standing = []
        for now in sorted({b for _, b, _ in rows}):
            seen = sorted(r for r in rows if r[1] <= now)
            groups = [[seen[0]]]
            for r in seen[1:]:
                if r[0] - groups[-1][-1][0] > gap:
                    groups.append([])
                groups[-1].append(r)
            for g in groups:
                new = sum(r[1] == now for r in g)
                if new:
                    s, e = g[0][0], g[-1][0]
                    gone = [k for k in standing if s <= k[2] <= e]
                    for k in gone:
                        out[k][-2:] = now, s
                    standing = [k for k in standing if k not in gone] + [(user, now, s)]
                    out[user, now, s] = [e, len(g), new, len(gone), sum(r[2] for r in g), None, None]
    return sorted((*k, *v) for k, v in out.items())


def random_events(seed):
    rng = random.Random(seed)
    out = []
    for user in range(12):
        span = rng.choice([500, 3000, 20000])
        for _ in range(rng.choice([1, 5, 40, 120])):
            at = rng.randrange(-span, span)
            out.append((user, at, max(-3, at // 1000 + rng.choice([0, 0, 1, 5, 9])), rng.randrange(2**32)))
    out += [out[0]] * 5  # repeated rows
    out += [(99, 60 * i, i // 3 if i % 7 else 300 - i, 1) for i in range(400)]  # one long chain, holes filled late
    out += [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1), (98, 0, 0, None)]
    return out


@pytest.mark.parametrize("stretch", [1, 16])
def test_versions(spark, monkeypatch, stretch):
    monkeypatch.setattr(sessions, "STRETCH", stretch)
    monkeypatch.setattr(sessions, "BATCHES", 4 * stretch)
    rows = random_events(stretch)
    df = spark.createDataFrame(rows, "user long, at long, batch long, amount long")
    for c in ("n", "x", "side", "start", "death", "up", "end", "birth"):
        df = df.withColumn(c, F.lit("x"))
    got = sessions.versions(df, 240)
    key = ("user", "batch", "start", "end", "n_events", "n_new", "n_retracted", "amount", "retracted_batch", "retracted_start")
    assert sorted((tuple(r[c] for c in key) for r in got.collect()), key=lambda r: r[:3]) == brute_versions(rows, 240)
    assert sessions.versions(df.limit(0), 240).count() == 0


def test_turn_events(spark):
    rows = [(9, 0, "user", "x"), (9, None, "user", "x"), (None, 3, "user", "x"), (123456, 7, None, None)]
    got = sessions.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for conv, turn in ((9, 0), (123456, 7)):
        c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
        at, g = c // 2 % 7200 + 300 * turn + h % 600, h // 600
        want.append((2 * (conv // 8) + c % 2, at, at // 1800 + (g % 4 if g % 3 == 0 else 0), h))
    assert [tuple(r) for r in got] == want


# --- 13


def brute_audit(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, part in rows:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((part or "", f, *labels.get(i, (0, 0))))
    out, total = {}, Counter()
    for part in {p for p, *_ in fails}:
        docs = [d for d in fails if d[0] == part]
        for order in permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [d for d in left if d[1][c]]
                left = [d for d in left if not d[1][c]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(d[1][c] for d in docs) - len(gone), sum(sum(d[1].values()) == 1 and d[1][c] for d in docs), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, c] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, docs, empty, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    vocab = [f"w{i}" for i in range(400)]
    for i in range(60):
        words = rng.choices(vocab[: rng.choice([50, 400])], k=rng.choice([20, 99, 100, 150]))
        text = " ".join(words)
        text = text.upper() if i % 5 == 0 else text
        rows.append((2000 + i, text + rng.choice(["", "", " #", "&", " A" * 15]), rng.choice(["en", "de", None])))
        if i % 6 == 0:
            rows += [rows[-1], (rng.choice([5000 + i, 1999 - i]), rows[-1][1], "de")]
    marks = {r[0]: (rng.randint(0, 1), rng.randint(0, 1)) for r in rows if r[0] is not None and rng.random() < 0.5}
    path = tmp_path / "tables"
    clashing(spark.createDataFrame(rows, DOCS)).write.parquet(f"{path}/documents.parquet")
    labels = [(i, q, t) for i, (q, t) in marks.items()] + [(i, 0, None) for i in list(marks)[:9]] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    got = filter_audit.op13_filter_shapley(spark, str(path)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(rows, marks)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    empty.write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/none/labels.parquet")
    assert filter_audit.op13_filter_shapley(spark, f"{path}/none").count() == 0


def test_audit_of_other_filters(spark):
    rows = [("a", 0b01, True, False), ("a", 0b11, None, True), ("a", 0, False, False), (None, 0b10, True, None)]
    got = filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), "XY").collect()
    assert sorted(tuple(r) for r in got if r.part == "a" and r.filter_order == "YX") == [("a", "YX", 1, 2, 1, 0, 0, 0, 1, 1), ("a", "YX", 2, 1, 1, 1, 1, 1, 0, 3)]
    assert {r.part for r in got} == {"a", ""}
