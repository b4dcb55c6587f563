"""Late session merging by lifetimes of cuts.

A user's events come in batches, in whatever order of time. After a batch, the events so far form sessions: neighbours at
most `gap` apart share one. Which positions in time start a session then follows from two numbers a position: it is
there from its own first batch on, and it is no start any more once an event within `gap` before it has come: its
death, the least batch in that range. So a start lives from birth to death, and the same holds for ends with time
mirrored; both are found by one range window.

The session of an event of batch B starts at the latest start before it that lives at B. A position that is dead at B
shares its session with the event that killed it, so it points there; following pointers whose death is at most B ends at
the living start. Pointers are doubled (with the latest death on the way), so an as-of match takes a few equi-joins on
(user, position), whatever the length of a session or of a user's history.

A version with start s is retracted by the next version with that start or, if there is none, when s dies, by the version
that holds the killing event. That makes a forest of versions; events are summed up along it, again by doubling.

No group is larger than a stretch of time: windows are cut at multiples of a width, with what a range needs of the
neighbouring stretch. Repeated events are counted first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrium.llm.common import release, table, written

#: Width of a stretch in gaps, and of a stretch of batches in the search for a start's next version.
STRETCH, BATCHES = 16, 1024
AT = ["user", "side", "x"]


def lifetimes(events: DataFrame, gap: int) -> DataFrame:
    """For (user, at, batch): (user, side, x, death, up) for each position that dies: x is its time on side 0 (starts) and its
    mirrored time on side 1 (ends), death the least batch of events within gap before x, and up where the first of those lies."""
    width = STRETCH * max(1, gap)
    births = events.groupBy("user", "at").agg(F.min("batch").alias("birth"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("at").alias("x")), F.struct(F.lit(1).alias("side"), (-F.col("at")).alias("x")))
    both = births.select("user", "birth", F.inline(sides))
    own = F.floor(F.col("x") / width).cast("long")
    reach = F.floor((F.col("x") + gap) / width).cast("long")
    dealt = both.select("*", own.alias("own"), F.explode(F.when(own == reach, F.array(own)).otherwise(F.array(own, reach))).alias("stretch"))
    near = Window.partitionBy("user", "side", "stretch").orderBy("x").rangeBetween(-gap, -1)
    killer = dealt.withColumn("k", F.min(F.struct("birth", "x")).over(near)).where("own = stretch and k is not null")
    return killer.select(*AT, F.col("k.birth").alias("death"), F.col("k.x").alias("up"))


def doubled(dying: DataFrame) -> list[DataFrame]:
    """Tables (user, side, x, up, death): pointers 1, 2, 4, ... steps up, with the latest death on the way; written."""
    out = [written(dying.select(*AT, "up", "death"))]
    while not out[-1].isEmpty():
        step = out[-1]
        over = step.select("user", "side", F.col("x").alias("up"), F.col("up").alias("over"), F.col("death").alias("later"))
        out.append(written(step.join(over, ["user", "side", "up"]).select(*AT, F.col("over").alias("up"), F.greatest("death", "later").alias("death"))))
    release(out.pop())
    return out


def living(asked: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """For (user, side, x, batch, ...): x becomes the latest position, from x on back, that lives at batch."""
    for step in reversed(steps):
        asked = asked.join(step, AT, "left").withColumn("x", F.when(F.col("death") <= F.col("batch"), F.col("up")).otherwise(F.col("x"))).drop("up", "death")
    return asked


def _next_batch(versions: DataFrame) -> DataFrame:
    """Adds after, the batch of the next version with the same user and start, null for the last; in stretches of batches."""
    stretch = F.floor(F.col("batch") / BATCHES).cast("long")
    within = Window.partitionBy("user", "start", "stretch").orderBy("batch")
    cut = versions.withColumn("stretch", stretch)
    firsts = cut.groupBy("user", "start", "stretch").agg(F.min("batch").alias("first"))
    ahead = firsts.select("user", "start", "stretch", F.lead("first").over(Window.partitionBy("user", "start").orderBy("stretch")).alias("ahead"))
    return cut.withColumn("near", F.lead("batch").over(within)).join(ahead, ["user", "start", "stretch"]).withColumn("after", F.coalesce("near", "ahead")).drop("stretch", "near", "ahead")


def _summed(forest: DataFrame) -> DataFrame:
    """For (user, batch, start, n, amount, to_batch, to_start), written: n and amount of all versions below each, itself
    included. Each round looks twice as far down."""
    here = ["user", "batch", "start"]
    now = written(forest.select(*here, F.col("to_batch").alias("b"), F.col("to_start").alias("s"), "n", "amount"))
    while True:
        rising = now.where("b is not null")
        if rising.isEmpty():
            return now.drop("b", "s")
        below = rising.groupBy("user", F.col("b").alias("batch"), F.col("s").alias("start")).agg(F.sum("n").alias("more"), F.sum("amount").alias("more_amount"))
        above = now.select("user", F.col("batch").alias("b"), F.col("start").alias("s"), F.col("b").alias("b2"), F.col("s").alias("s2"))
        new = now.join(below, here, "left").join(above, ["user", "b", "s"], "left").select(
            *here, F.col("b2").alias("b"), F.col("s2").alias("s"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("amount") + F.coalesce("more_amount", F.lit(0))).alias("amount")
        )
        new = written(new)
        release(now)
        now = new


def versions(events: DataFrame, gap: int) -> DataFrame:
    """For events (user, at, batch, amount; all long), a row for each version of a session: user, batch, start, end (first and
    last event), n_events, n_new (of that batch), n_retracted (standing sessions that it replaces), amount (over all
    n_events), and retracted_batch and retracted_start of the version that replaces it, null if none does.

    Equal events count each. Events without user, time or batch belong to no session and are left out; a null amount counts 0.
    No events give no versions; other columns are not looked at.
    """
    per = events.select(*[F.col(c).cast("long").alias(c) for c in ("user", "at", "batch", "amount")]).where("user is not null and at is not null and batch is not null")
    per = written(per.groupBy("user", "at", "batch").agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount")))
    dying = written(lifetimes(per, gap))
    steps = doubled(dying)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), x.alias("x")) for i, x in enumerate((F.col("at"), -F.col("at")))])
    found = living(per.select("*", F.inline(sides)), steps)
    pick = lambda side, c: F.max(F.when(F.col("side") == side, c))
    found = written(found.groupBy("user", "at", "batch").agg(pick(0, F.col("x")).alias("start"), (-pick(1, F.col("x"))).alias("end"), F.first("n").alias("n"), F.first("amount").alias("amount")))
    made = written(found.groupBy("user", "batch", "start").agg(F.first("end").alias("end"), F.sum("n").alias("n"), F.sum("amount").alias("amount")))
    deaths = dying.where("side = 0").select("user", F.col("x").alias("start"), "death", "up")
    killers = found.select("user", F.col("at").alias("up"), F.col("batch").alias("death"), F.col("start").alias("other"))
    known = _next_batch(made).join(deaths, ["user", "start"], "left").join(killers, ["user", "up", "death"], "left")
    to_batch, to_start = F.coalesce("after", "death").alias("to_batch"), F.when(F.col("after").isNotNull(), F.col("start")).otherwise(F.col("other")).alias("to_start")
    forest = written(known.select("user", "batch", "start", "end", "n", "amount", to_batch, to_start))
    sums = _summed(forest)
    gone = forest.where("to_batch is not null").groupBy("user", F.col("to_batch").alias("batch"), F.col("to_start").alias("start")).agg(F.count("*").alias("n_retracted"))
    for t in (per, dying, *steps, found, made):
        release(t)
    out = forest.select("user", "batch", "start", "end", F.col("n").alias("n_new"), "to_batch", "to_start").join(sums, ["user", "batch", "start"]).join(gone, ["user", "batch", "start"], "left")
    return out.select(
        "user", "batch", "start", "end", F.col("n").alias("n_events"), "n_new", F.coalesce("n_retracted", F.lit(0)).alias("n_retracted"), "amount",
        F.col("to_batch").alias("retracted_batch"), F.col("to_start").alias("retracted_start"),
    )


def turn_events(conversations: DataFrame) -> DataFrame:
    """The contract's events: (user, at, batch, amount) of turns, placed by checksums of their numbers."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    x = conversations.where("turn is not null and conv_id is not null").select(
        conv.alias("conv"), turn.alias("turn"), F.crc32(conv.cast("string").cast("binary")).alias("c"), F.crc32(F.concat_ws(":", conv.cast("string"), turn.cast("string")).cast("binary")).alias("h")
    )
    x = x.select((2 * F.shiftright("conv", 3) + F.col("c") % 2).alias("user"), (F.expr("c div 2") % 7200 + 300 * F.col("turn") + F.col("h") % 600).alias("at"), F.expr("h div 600").alias("g"), F.col("h").alias("amount"))
    late = F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(0)
    return x.select("user", "at", (F.expr("(at - pmod(at, 1800)) div 1800") + late).alias("batch"), "amount")


def op12_session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(turn_events(table(spark, sf_dir, "conversations")), 240)
    return v.withColumnsRenamed({"start": "start_s", "end": "end_s", "amount": "h_sum", "retracted_start": "retracted_start_s"})


OP12_SQL = """
WITH ids AS (SELECT conv_id, turn, row_number() OVER () AS r FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
named AS (SELECT r, 'c' AS kind, conv_id::VARCHAR AS s FROM ids UNION ALL SELECT r, 'h', conv_id::VARCHAR || ':' || turn::VARCHAR FROM ids),
crc AS (
  SELECT r, kind, xor(list_reduce(flatten(list_transform(string_split(s, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) AS v FROM named),
raw AS (
  SELECT i.conv_id, i.turn, c.v AS c, h.v AS h FROM ids i JOIN crc c ON c.r = i.r AND c.kind = 'c' JOIN crc h ON h.r = i.r AND h.kind = 'h'),
placed AS (
  SELECT (2 * (conv_id >> 3) + c % 2)::BIGINT AS "user", ((c // 2) % 7200 + 300 * turn + h % 600)::BIGINT AS sec, h, CASE WHEN (h // 600) % 3 = 0 THEN (h // 600) % 4 ELSE 0 END AS late FROM raw),
ev AS (SELECT "user", sec, h, (floor(sec / 1800)::BIGINT + late)::BIGINT AS batch FROM placed),
ub AS (SELECT DISTINCT "user" AS u, batch AS b FROM ev),
snap AS (
  SELECT u, b, sec, h, batch, CASE WHEN sec - lag(sec) OVER (PARTITION BY u, b ORDER BY sec) <= 240 THEN 0 ELSE 1 END AS cut FROM ub JOIN ev ON ev."user" = u AND batch <= b),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY u, b ORDER BY sec RANGE UNBOUNDED PRECEDING) AS k FROM snap),
v AS (
  SELECT u, b, min(sec) AS s, max(sec) AS e, count(*) AS n, count(*) FILTER (batch = b) AS n_new, sum(h)::BIGINT AS hs FROM numbered GROUP BY u, b, k HAVING count(*) FILTER (batch = b) > 0),
gone AS (
  SELECT a.u, a.b, a.s, min({'b': c.b, 's': c.s}) AS nx FROM v a JOIN v c ON c.u = a.u AND c.b > a.b AND c.s <= a.s AND c.e >= a.e GROUP BY ALL),
took AS (SELECT u, nx.b AS b, nx.s AS s, count(*) AS n FROM gone GROUP BY ALL)
SELECT v.u AS "user", v.b AS batch, v.s AS start_s, v.e AS end_s, v.n AS n_events, v.n_new, coalesce(took.n, 0) AS n_retracted, v.hs AS h_sum, gone.nx.b AS retracted_batch, gone.nx.s AS retracted_start_s
FROM v LEFT JOIN gone ON gone.u = v.u AND gone.b = v.b AND gone.s = v.s LEFT JOIN took ON took.u = v.u AND took.b = v.b AND took.s = v.s
"""
