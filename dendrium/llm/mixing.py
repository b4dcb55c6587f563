"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a budget of words. Its documents have a fixed pseudo-random place (52 bits of an MD5 of id and
text); the mix takes each document floor(budget / size) times, and once more those whose place lies below a
threshold at which the rest of the budget is spent. The threshold is found without sorting: words are summed by
source and bucket of the place, the bucket in which the budget ends is the boundary, and only the documents of
the boundary buckets are summed again by finer bits, until a boundary bucket is a single place. Of the rows in that
place (one row, or rows equal in id and text) as many are taken as bring the source nearest to its budget. The filter is
then one comparison a row; only where a part of a place's rows is taken are those rows, and no others, numbered.

What comes to the driver is a few numbers a source at each level; everything about documents stays distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrium.llm.common import WORD, release, table, written

PLACE_BITS, LEVEL_BITS = 52, 13
#: Sources up to which their plan, a row each, is broadcast; with more it is joined by shuffle.
MOST_BROADCAST = 100_000


def place_of(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("~")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[object, int]], weights=(1, 2, 3), most: float = 3.0) -> list[float]:
    """Budgets in words for (source, size) in order: shares of all words by the repeating weights, none above most
    times its source's size; the excess is shared again by weight until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, share, level = sum(n for _, n in sizes), sum(w), 0.0
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i][1] / w[i], i))
    out = [0.0] * len(sizes)
    for k, i in enumerate(order):
        level = left / share
        if most * sizes[i][1] / w[i] >= level:
            for j in order[k:]:
                out[j] = level * w[j]
            break
        out[i] = most * sizes[i][1]
        left -= most * sizes[i][1]
        share -= w[i]
    return out


def plan(narrow: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> list[tuple]:
    """For narrow (source, size, place): a row for each source with source, source_size, target, whole (times that
    every document is taken), threshold (documents placed below it are taken once more) and some (how many of those in
    that very place are taken once more)."""
    totals = narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()
    totals = sorted(((r.source, r.n) for r in totals), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    goal = targets(totals, weights, most)
    found = []
    state = {}  # source number -> [low place of the boundary bucket, words below it, budget of the partial copy]
    for i, ((source, n), t) in enumerate(zip(totals, goal, strict=True)):
        whole = int(t // n) if n else 0
        rest = t - whole * n if n else 0.0
        found.append([source, n, t, whole, 0, 0])
        if n and rest > 0:
            state[i] = [0, 0, rest]
    bits = PLACE_BITS
    spark = narrow.sparkSession
    while state and bits:
        bits -= LEVEL_BITS
        edges = spark.createDataFrame([(found[i][0], s[0] >> (bits + LEVEL_BITS), float(s[2] - s[1])) for i, s in state.items()], "e_source string, e_prefix long, e_left double")
        inside = narrow.join(_small(edges, len(state)), F.col("source").eqNullSafe(F.col("e_source")) & (F.shiftright("place", bits + LEVEL_BITS) == F.col("e_prefix")))
        sums = inside.groupBy("source", F.shiftright("place", bits).alias("bucket")).agg(F.sum("size").alias("words"), F.max("e_left").alias("left"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.count("*").alias("rows"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = sums.withColumn("upto", F.sum("words").over(upto)).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
        number = {found[i][0]: i for i in state}
        for r in cut.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "lo", "hi", "rows")).alias("b")).collect():
            i, b = number.pop(r.source), r.b
            s = state[i]
            if b.lo == b.hi:  # one place is left
                some = min(b.rows, math.ceil((s[2] - s[1] - b.upto + b.words) * b.rows / b.words - 0.5))
                found[i][4:] = (b.lo + 1, 0) if some == b.rows else (b.lo, some)
                del state[i]
            else:
                state[i] = [b.bucket << bits, s[1] + b.upto - b.words, s[2]]
        for i in number.values():  # the budget is not reached in what is left: rounding of a whole copy
            found[i][4:] = 1 << PLACE_BITS, 0
            del state[i]
    return [tuple(f) for f in found]


def mix(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """Returns the rows of docs as column doc (a struct), with size, source_size, target and copies (how often the mix
    takes the document, at most `most` rounded up).

    A null text has size 0; documents of size 0 follow the same rule as others. A null source is a source, the last
    in order. Rows equal in id and text share one place, and each is taken for itself, so that a part of them may be. No rows
    give no rows. Other columns are carried in doc and cannot clash.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text, source = F.col("doc.text"), F.col("doc.source")
    narrow = written(rows.select(source.alias("source"), size_of(text).alias("size"), place_of(F.col("doc.doc_id"), text).alias("place")))
    made = plan(narrow, weights, most)
    release(narrow)
    full = rows.select("doc", size_of(text).alias("size"), place_of(F.col("doc.doc_id"), text).alias("place"))
    return _with_copies(full, made, F.col("doc.source")).select("doc", "size", "source_size", "target", "copies")


def _small(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows, to be broadcast if they are few."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def _with_copies(rows: DataFrame, made: list[tuple], source: Column) -> DataFrame:
    per = rows.sparkSession.createDataFrame(made, "p_source string, source_size long, target double, whole long, threshold long, some long")
    joined = rows.join(_small(per, len(made)), source.eqNullSafe(F.col("p_source")))
    plain = joined.withColumn("copies", F.col("whole") + (F.col("place") < F.col("threshold")).cast("long"))
    if not any(m[5] for m in made):
        return plain
    at = (F.col("place") == F.col("threshold")) & (F.col("some") > 0)
    return plain.where(~at).unionByName(_some_of(joined.where(at)))


def _some_of(rows: DataFrame) -> DataFrame:
    """The rows of boundary places with copies; `some` of each source's are taken once more. They are written with a number, whose
    high bits are the task's, and ranked by task, so that a place with very many rows is no single task."""
    rows = written(rows.withColumn("own", F.monotonically_increasing_id()))
    rows = rows.withColumn("task", F.shiftright("own", 33))
    before = Window.partitionBy("p_source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("p_source", "task").count().select(F.col("p_source").alias("q_source"), F.col("task").alias("q_task"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("p_source", "task").orderBy("own")))
    ranked = ranked.join(tasks, F.col("p_source").eqNullSafe(F.col("q_source")) & (F.col("task") == F.col("q_task")))
    return ranked.withColumn("copies", F.col("whole") + (F.col("ahead") + F.col("rank") <= F.col("some")).cast("long")).drop("own", "task", "rank", "ahead", "q_source", "q_task")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), place_of(F.col("doc_id"), F.col("text")).alias("place")))
    out = _with_copies(narrow, plan(narrow), F.col("source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(text, '')), 1, 13))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM d GROUP BY source),
o AS (
  SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3.0::DOUBLE * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY 3.0::DOUBLE * n / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
    3.0::DOUBLE * n / w AS r, row_number() OVER (ORDER BY 3.0::DOUBLE * n / w, i) AS k
  FROM s),
f AS (SELECT min(k) AS k FROM o WHERE r >= level),
t AS (
  SELECT o.source, o.n, CASE WHEN o.k < f.k THEN 3.0::DOUBLE * o.n ELSE (SELECT x.level FROM o x WHERE x.k = f.k) * o.w END AS target FROM o, f),
c AS (SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole FROM t),
p AS (
  SELECT d.source, d.place, c.target - c.whole * c.n AS rest,
    sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.place ROWS UNBOUNDED PRECEDING) AS upto, sum(d.size) AS words, count(*) AS n
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.source, d.place, c.target, c.whole, c.n),
g AS (
  SELECT source, place, CASE WHEN upto <= rest THEN n WHEN upto - words <= rest THEN least(n, ceil((rest - (upto - words)) * n / words - 0.5)::BIGINT) ELSE 0 END AS some
  FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source, place) AS r FROM d)
SELECT r.doc_id, r.size, c.n AS source_size, c.target, ((c.whole + CASE WHEN c.target > c.whole * c.n AND r.r <= g.some THEN 1 ELSE 0 END) * r.size)::BIGINT AS taken
FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source
JOIN g ON r.source IS NOT DISTINCT FROM g.source AND r.place = g.place
"""
