"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything that is no letter becomes one blank, and every 1- to 3-gram that holds a letter
is hashed to one of 2**16 features. Counts by language, with add-half smoothing, give a matrix of log-probabilities;
its size is features times languages, whatever the corpus, and it is broadcast. A batch of texts is scored at once:
one numpy pass makes the features of all its characters, and the matrix rows are summed by text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.llm.common import held_out, table
from dendrium.llm.packing import slices

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Bound on the labelled rows that the counts are made from. Fitting is the only step that may sample.
FIT_ROWS = 20_000
SLICE_BYTES = 1_000_000

_fold: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else 0."""
    global _fold
    if _fold is None:
        table_ = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table_[c] = ord(low) if len(low) == 1 else c
        _fold = table_
    return _fold


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All features of the texts in order, how many each has, and whether each has a letter."""
    joined = " \0 ".join(texts) + " \0 "
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    c = letters()[raw]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)  # runs of blanks are one blank
    keep[1:] |= owner[1:] != owner[:-1]
    c, owner = c[keep], owner[keep]
    out, whose = [], []
    h = np.zeros(len(c), np.uint64)
    letter = c != 0
    any_letter = np.zeros(len(texts), bool)
    any_letter[owner[letter]] = True
    held = np.zeros(len(c), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :].astype(np.uint64) + np.uint64(n)
        held = held[:m] | letter[n - 1 :]
        if n in ORDERS:
            ok = held & (owner[:m] == owner[n - 1 :])
            mixed = h[ok] * np.uint64(0xD6E8FEB86659FD93)
            out.append((mixed >> np.uint64(48)).astype(np.int64))
            whose.append(owner[:m][ok])
    return out, whose, any_letter


def count_matrix(texts: list[str], languages: np.ndarray, n_languages: int) -> np.ndarray:
    """Feature counts by language, flattened."""
    out, whose, _ = features(texts)
    total = np.zeros(n_languages * FEATURES, np.int64)
    for f, w in zip(out, whose, strict=True):
        total += np.bincount(languages[w] * FEATURES + f, minlength=len(total))
    return total


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix (features x languages) of log-probabilities. Only rows whose id is not held
    out, with a text and a language, are learned from, about fit_rows of them by a hash of the id."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((FEATURES, 0), np.float32)
    number = {k: i for i, k in enumerate(names)}
    share = min(1.0, fit_rows / sum(sizes.values()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches):
        import pyarrow as pa

        total = np.zeros(len(names) * FEATURES, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                total += count_matrix(part.column("text").to_pylist(), np.array([number[x] for x in part.column("lang").to_pylist()], np.int64), len(names))
        used = np.flatnonzero(total)
        for a in range(0, len(used), 50_000):
            at = used[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["feature", "n"])

    counts = np.zeros(len(names) * FEATURES)
    for r in rows.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.feature] = r.n
    counts = counts.reshape(len(names), FEATURES).T + SMOOTHING
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def score(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text; 'und' and 0 for null or without a letter."""
    out, whose, any_letter = features([t or "" for t in texts])
    total = np.zeros((len(texts), len(names)))
    for f, w in zip(out, whose, strict=True):
        if len(f):
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            total[w[first]] += np.add.reduceat(matrix[f], first, axis=0, dtype=np.float64)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    p = np.where(any_letter, 1 / odds.sum(axis=1), 0.0)
    return [names[b] if a else "und" for a, b in zip(any_letter, best, strict=True)], p


def identify(docs: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """Returns doc_id, held_out, lang_pred and score (the posterior, 0 to 1), a row for each row of docs. Only the text
    is looked at. A null text, or one without a letter, is 'und' with score 0; so is every text if no language
    was learned. Long texts are scored whole."""
    shipped = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lang, p = score(part.column("text").to_pylist(), names, shipped.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(p)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, *fit(docs))
