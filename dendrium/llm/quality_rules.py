"""Quality rules: fixed base rules, then robust multivariate outliers.

Every document has a vector of transformed statistics (word length, symbols, capitals, repeated lines, repeated
words). For every language and source a minimum-covariance-determinant estimate is made. A concentration step takes the
mean and covariance of the rows whose distances are among the smaller three quarters, and measures distances anew; this
lowers the determinant. Three starts (around the lower quartiles, the medians and the upper quartiles) make START_STEPS
steps each; the one with the least determinant goes on until no group's log-determinant falls by SETTLED. Variances
have FLOORS squared added throughout, so the determinant is that of the regularized covariance. A document goes if its
squared Mahalanobis distance is above CUT.

All of it is DataFrame functions. Texts are read once for a narrow table of statistics; the steps read only that.
A step's estimates are one row a group, summed map-side, so a source with a third of all rows is no hot task.
Groups with fewer than LEAST_ROWS usable rows share their language's estimate, and languages with too few share
one estimate; where even that has too few rows there is no verdict but the base rules'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dendrium.llm.common import SPACES, release, table, words_of, written

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Transformed statistics, and the least standard deviation that an estimate may give each of them.
Z = ("z_length", "z_symbols", "z_upper", "z_lines", "z_repeats")
FLOORS = (0.06, 0.05, 0.06, 0.08, 0.08)
#: Median of chi-square with 5 degrees of freedom; squared distance beyond which a row goes (0.999999 quantile).
MEDIAN, CUT = 4.351, 35.9
KEPT_SHARE, START_STEPS, SETTLED, LEAST_ROWS = 0.75, 2, 0.01, 60


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes holds the windows' hashes in order."""
    near = lambda s, k, e: F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))
    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    twice = let(ordered, lambda s: F.filter(s, lambda e, k: near(s, k - 1, e) | near(s, k + 1, e)))
    places = F.sort_array(F.transform(twice, lambda e: e["i"]))
    return let(places, lambda p: F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))


def with_statistics(rows: DataFrame, text: Column) -> DataFrame:
    """Adds s, a struct of the base statistics of a text (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    solid = F.translate(t, SPACES, "")
    n = F.col("_n")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return (
        rows.withColumns({"_words": words_of(text), "_solid": solid, "_lines": lines})
        .withColumn("_n", F.size("_words"))
        .withColumn("_hashes", hashes)
        .withColumn(
            "s",
            F.struct(
                n.cast("long").alias("n_words"), F.length("_solid").cast("long").alias("word_chars"),
                (F.length("_solid") - F.length(F.translate("_solid", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                F.when(F.size(F.array_distinct("_hashes")) == F.size("_hashes"), F.lit(0)).otherwise(_covered(F.col("_hashes"))).cast("long").alias("n_repeat_words"),
                (F.length("_solid") - F.length(F.translate("_solid", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
                F.size("_lines").cast("long").alias("n_lines"),
            ),
        )
        .drop("_words", "_solid", "_lines", "_n", "_hashes")
    )


def base_failed(s: str = "s") -> Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


def with_vector(rows: DataFrame) -> DataFrame:
    """Adds the columns Z, shrunk so that short texts do not look odd by chance, and usable (base rules passed)."""
    c = lambda k: F.col(f"s.{k}").cast("double")
    vector = (
        F.log((c("word_chars") + 120) / (c("n_words") + 20)), F.sqrt(c("n_symbols") / (c("word_chars") + 200)), F.sqrt(c("n_upper") / (c("word_chars") + 200)),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 20)), F.sqrt(c("n_repeat_words") / (c("n_words") + 50)),
    )
    return rows.withColumns({k: v for k, v in zip(Z, vector, strict=True)} | {"usable": ~base_failed()})


def _groups(narrow: DataFrame) -> DataFrame:
    """For each language and source: the group whose estimate holds for it (null: none)."""
    sizes = narrow.groupBy("lang", "source").agg(F.sum(F.col("usable").cast("long")).alias("n"))
    sums = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang")).select(F.col("lang").alias("k"), "n_lang")
    total = sizes.agg(F.sum("n").alias("n_all"))
    rows = sizes.join(sums, F.col("lang").eqNullSafe(F.col("k"))).join(F.broadcast(total))  # one row
    part = lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-"))
    group = (
        F.when(F.col("n") >= LEAST_ROWS, F.concat(F.lit("source"), part(F.col("lang")), F.lit("\x01"), part(F.col("source"))))
        .when(F.col("n_lang") >= LEAST_ROWS, F.concat(F.lit("language"), part(F.col("lang"))))
        .when(F.col("n_all") >= LEAST_ROWS, F.lit("all"))
    )
    return rows.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), group.alias("grp"))


def _with_estimates(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Joins a group's estimates to its rows and adds d2, the squared distance."""
    out = rows.join(estimates.withColumnRenamed("grp", "e_grp"), F.col("grp") == F.col("e_grp"), "left").drop("e_grp")
    terms = []
    for i, z in enumerate(Z):
        rest = F.col(z) - F.col("m")[i]
        for j in range(i):
            rest = rest - F.col("l")[i * (i + 1) // 2 + j] * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col("l")[i * (i + 1) // 2 + i])
        terms.append(F.col(f"y{i}") * F.col(f"y{i}"))
    return out.withColumn("d2", sum(terms[1:], terms[0]) / F.col("c")).drop("m", "l", "c", *[f"y{i}" for i in range(len(Z))])


def _moments(rows: DataFrame) -> DataFrame:
    """Means and the Cholesky factor of the covariance (with the floors on its diagonal) of each group of rows."""
    p = len(Z)
    out = rows.groupBy("grp").agg(
        F.count("*").cast("double").alias("k"), *[F.sum(z).alias(f"s{i}") for i, z in enumerate(Z)],
        *[F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"q{i}_{j}") for i in range(p) for j in range(i + 1)],
    )
    out = out.select("grp", *[(F.col(f"s{i}") / F.col("k")).alias(f"m{i}") for i in range(p)], *[
        (F.col(f"q{i}_{j}") / F.col("k") - F.col(f"s{i}") / F.col("k") * F.col(f"s{j}") / F.col("k") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"v{i}_{j}")
        for i in range(p) for j in range(i + 1)
    ])
    for i in range(p):
        for j in range(i + 1):
            v = F.col(f"v{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2))) if i == j else v / F.col(f"l{j}_{j}"))
    return out.select("grp", F.array(*[f"m{i}" for i in range(p)]).alias("m"), F.array(*[f"l{i}_{j}" for i in range(p) for j in range(i + 1)]).alias("l"), F.lit(1.0).alias("c"))


def _step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """The estimates after one concentration step of each group, written."""
    far = _with_estimates(rows, now)
    cut = written(far.groupBy("grp").agg(F.percentile_approx("d2", KEPT_SHARE, 1000).alias("cut")).withColumnRenamed("grp", "c_grp"))
    new = written(_moments(far.join(cut, F.col("grp") == F.col("c_grp")).where(F.col("d2") <= F.col("cut"))))
    release(cut)
    return new


def _log_determinant(factor: Column) -> Column:
    """Of a covariance, from its Cholesky factor."""
    logs = [F.log(F.get(factor, F.lit(i * (i + 3) // 2))) for i in range(len(Z))]
    return 2 * sum(logs[1:], logs[0])


def estimate(narrow: DataFrame) -> DataFrame:
    """For narrow (lang, source, Z, usable): a row for each language and source with its estimate: m (means), l (Cholesky
    factor, row by row) and c (what squared distances are divided by); null where there are too few rows."""
    p = len(Z)
    groups = written(_groups(narrow))
    rows = narrow.where("usable").join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))).where(F.col("grp").isNotNull()).select("grp", *Z)
    quarters = rows.groupBy("grp").agg(*[F.percentile_approx(z, [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i, z in enumerate(Z)])
    spread = lambda i: F.sqrt(F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2)
    starts = F.explode(F.array(*[F.struct(F.lit(str(q)).alias("start"), F.array(*[F.col(f"p{i}")[q] for i in range(p)]).alias("m")) for q in range(3)]))
    spreads = F.array(*[spread(i) if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)])
    tried = written(quarters.select("grp", spreads.alias("l"), starts.alias("s")).select(F.concat("s.start", "grp").alias("grp"), F.col("s.m").alias("m"), "l", F.lit(1.0).alias("c")))
    thrice = rows.select(F.explode(F.array(*[F.lit(str(q)) for q in range(3)])).alias("start"), "grp", *Z).select(F.concat("start", "grp").alias("grp"), *Z)
    for _ in range(START_STEPS):
        tried, old = _step(thrice, tried), tried
        release(old)
    best = tried.groupBy(F.expr("substring(grp, 2)").alias("grp")).agg(F.min(F.struct(_log_determinant(F.col("l")).alias("det"), F.col("grp").alias("start"), "m", "l", "c")).alias("e"))
    now = written(best.select("grp", "e.m", "e.l", "e.c"))
    release(tried)
    while True:
        new = _step(rows, now)
        both = new.join(now.select(F.col("grp").alias("o_grp"), F.col("m").alias("o_m"), F.col("l").alias("o_l")), F.col("grp") == F.col("o_grp"))
        fall = _log_determinant(F.col("o_l")) - _log_determinant(F.col("l"))
        moved = Observation()
        lower = both.withColumn("fall", fall).observe(moved, F.max("fall").alias("fall"))
        kept = lambda c: F.when(F.col("fall") > 0, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
        least = written(lower.select("grp", kept("m"), kept("l"), "c"))
        release(now), release(new)
        now = least
        if (moved.get["fall"] or 0.0) < SETTLED:
            break
    scale = _with_estimates(rows, now).groupBy("grp").agg(F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5, 1000) / MEDIAN).alias("scale"))
    last = now.drop("c").join(scale.withColumnRenamed("grp", "s_grp"), F.col("grp") == F.col("s_grp")).select("grp", "m", "l", F.col("scale").alias("c"))
    out = written(groups.join(last.withColumnRenamed("grp", "e_grp"), F.col("grp") == F.col("e_grp"), "left").drop("e_grp"))
    release(now), release(groups)
    return out


def _judged(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds kept and d2 to rows with s, Z, lang and source."""
    per = estimates.select("g_lang", "g_source", "grp", F.struct("m", "l", "c").alias("_e"))
    out = rows.join(per, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source", "grp")
    terms = []
    for i, z in enumerate(Z):
        rest = F.col(z) - F.col("_e.m")[i]
        for j in range(i):
            rest = rest - F.col("_e.l")[i * (i + 1) // 2 + j] * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", rest / F.col("_e.l")[i * (i + 1) // 2 + i])
        terms.append(F.col(f"_y{i}") * F.col(f"_y{i}"))
    out = out.withColumn("d2", sum(terms[1:], terms[0]) / F.col("_e.c")).drop("_e", *[f"_y{i}" for i in range(len(Z))])
    return out.withColumn("kept", F.col("usable") & F.coalesce(F.col("d2") <= CUT, F.lit(True)))


def judge(docs: DataFrame) -> DataFrame:
    """Returns doc_id, the base statistics, base_failed, d2 (squared distance; null without an estimate) and kept, a row
    for each row of docs.

    A null or empty text has no words and fails the base rules. Null languages and null sources are groups of their
    own. Repeated rows count each. Columns besides doc_id, text, lang and source are not looked at.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"), F.col("text").alias("_text"))
    narrow = written(with_vector(with_statistics(rows, F.col("_text")).drop("_text")))
    out = _judged(narrow, estimate(narrow))
    return out.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", (~F.col("usable")).alias("base_failed"), "d2", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps. Rows are written once beside their statistics: the
    steps read the statistics alone, and neither texts nor plans are gone through again."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"))
    full = written(with_vector(with_statistics(rows, F.col("doc.text"))).select("doc", "lang", "source", *Z, "usable"))
    return _judged(full, estimate(full.drop("doc"))).where("kept").select("doc.*")


def op5_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
