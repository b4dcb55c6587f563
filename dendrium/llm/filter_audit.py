"""Filter interaction audit by multilinear extensions.

A document is a mask: the set of filters that it fails. Everything asked for follows from how many documents of a part have
each mask, so the corpus is counted once, and what is left is a table of at most 2 ** filters counts a part.

What filters S remove of a part is a polynomial in x_1 ... x_k, multilinear, whose corners are the sets S: a mask m adds
1 - prod over i in m of (1 - x_i). Its corners give survivors, what a step removes, what is redundant and what one filter
removes alone, in any order; its partial derivative by x_i, integrated over the diagonal, is filter i's mean over all
orders, an exact rational with a denominator that divides k!.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.llm.common import lean, table, written
from dendrium.llm.packing import slices

SLICE_BYTES = 2_000_000
LETTERS = "ABCDE"
#: Fixed values of the contract: characters of which any fails D.
MARKS = b"#$%&*|"


class Removal:
    """How many documents of weights by mask the filters in a set remove, as a multilinear polynomial: coefficient[T] belongs
    to the product of the variables in T (a bit set)."""

    def __init__(self, weights: dict[int, int], filters: int):
        self.filters, self.coefficient = filters, {}
        for t in range(1, 1 << filters):
            above = sum(w for m, w in weights.items() if m & t == t)
            if above:
                self.coefficient[t] = above if t.bit_count() % 2 else -above

    def corner(self, chosen: int) -> int:
        """The value where the chosen variables are 1 and the others 0."""
        return sum(a for t, a in self.coefficient.items() if t & chosen == t)

    def mean(self, i: int) -> Fraction:
        """The integral from 0 to 1 of the derivative by variable i where all are equal."""
        return sum((Fraction(a, t.bit_count()) for t, a in self.coefficient.items() if t >> i & 1), Fraction(0))


def report(masks: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """For {mask: (documents, good, toxic)}: (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for every order of the letters and every step; shapley is over all orders, hence whole."""
    k = len(letters)
    n, good, toxic = (Removal({m: w[j] for m, w in masks.items()}, k) for j in range(3))
    total, every, full = sum(w[0] for w in masks.values()), (1 << k) - 1, factorial(k)
    corners = [[p.corner(s) for s in range(1 << k)] for p in (n, good, toxic)]
    fails = [corners[0][1 << i] for i in range(k)]
    alone = [corners[0][every] - corners[0][every & ~(1 << i)] for i in range(k)]
    shapley = [n.mean(i) * full for i in range(k)]
    assert all(s.denominator == 1 for s in shapley)
    rows = []
    for order in permutations(range(k)):
        before, name = 0, "".join(letters[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good_lost, toxic_lost = (c[after] - c[before] for c in corners)
            rows.append((name, step, total - corners[0][after], removed, fails[i] - removed, alone[i], good_lost, toxic_lost, int(shapley[i])))
            before = after
    return rows


def audit(documents: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For (part string, mask int, good boolean, toxic boolean), a row a document, mask bit i set if it fails letters[i]: the
    report of each part. A null part counts as '', a null good or toxic as false. No documents give no rows.

    Documents are counted by part and mask, with partial sums; a part is then one row of at most 2 ** filters entries.
    """
    ones = [F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c) for c in ("good", "toxic")]
    counted = documents.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(F.count("*").alias("n"), *ones)
    return _reported(counted, letters)


def _reported(counted: DataFrame, letters: str) -> DataFrame:
    per = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                rows = report({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}, letters)
                columns = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return per.mapInArrow(lean(run), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[3:]))


def text_masks(texts) -> tuple[np.ndarray, list[bytes]]:
    """Of an Arrow string array (null: empty): bits 0 to 3 for what each text fails of A to D, and a 128-bit digest of it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    n = len(texts)
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1] if n else 0]

    def count(which: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(which, dtype=np.int64)))
        return upto[ends] - upto[starts]

    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    owner = np.repeat(np.arange(n), np.asarray(pc.list_value_length(words), np.int64))
    full = np.asarray(pc.binary_length(flat), np.int64) > 0
    owner, codes = owner[full], np.asarray(pc.dictionary_encode(flat).indices, np.int64)[full]
    n_words = np.bincount(owner, minlength=n)
    kinds = int(codes.max(initial=0)) + 1
    distinct = np.bincount(np.unique(owner * kinds + codes) // kinds, minlength=n)
    capitals, points = count((raw >= 65) & (raw <= 90)), count((raw & 0xC0) != 0x80)
    marks = count(np.isin(raw, np.frombuffer(MARKS, np.uint8)))
    fails = (n_words < 100, 100 * distinct < 80 * n_words, 100 * capitals > 10 * points, marks > 0)
    view = memoryview(raw)
    digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails)), digests


def masked(docs: DataFrame, part: Column) -> DataFrame:
    """(doc_id, part, mask) of all rows of docs (doc_id, text): bits 0 to 4 for what whole texts fail of A to E.

    Texts are equal if their 128-bit digests are. A null text is empty. A row with a null doc_id neither fails E nor makes
    another row fail it; rows that repeat an id and its text do not fail E by each other.
    Only digests that several rows have are joined back, so a text that a third of the rows has is summed up first and split
    by the join.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.cast("string").alias("part"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                mask, digests = text_masks(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), pa.array(digests, pa.binary()), pa.array(mask, pa.int32())], names=["doc_id", "part", "digest", "mask"])

    narrow = written(rows.mapInArrow(lean(run), "doc_id long, part string, digest binary, mask int"))
    shared = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return narrow.join(shared, "digest", "left").select("doc_id", "part", F.when(later, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def op13_filter_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = masked(table(spark, sf_dir, "documents"), F.col("lang"))
    counted = masks.groupBy("doc_id", F.coalesce("part", F.lit("")).alias("part"), "mask").agg(F.count("*").alias("n"))
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(one("quality"), one("toxic"))
    marked = counted.join(labels, "doc_id", "left")
    lost = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return _reported(marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *lost), LETTERS)


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
f AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > low, false)] AS f FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT o, step, ascii(o[step]) - 64 AS i, [ascii(o[j]) - 64 for j in range(1, step)] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, o, step, i, n, good, toxic, f[i] AS fails, len([j for j in before if f[j]]) > 0 AS gone, len([j for j in range(1, 6) if f[j]]) = 1 AS single FROM s, m),
g AS (
  SELECT part, o AS filter_order, step::INT AS step, i, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM g
"""
