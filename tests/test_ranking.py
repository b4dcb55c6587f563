"""Max-constituents decoding against enumeration of all trees over the derivations' spans."""

import math
import random
from collections import defaultdict

from dendrium.operators import ranking

SCHEMA = "sent long, derivation int, cost double, label string, s int, e int"


def test_max_constituents(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for sent in range(25):
        n, mass, total = rng.randint(1, 6), defaultdict(float), 0.0

        def brackets(s, e):
            if e - s == 1:
                return [(rng.choice("ab"), s, e)]
            m = rng.randint(s + 1, e - 1)
            return [(rng.choice("XY"), s, e), *brackets(s, m), *brackets(m, e)]

        for d in range(rng.randint(1, 4)):
            cost = rng.choice([700.5, 701.25, 702.0])
            total += math.exp(700 - cost)
            for b in brackets(0, n):
                rows.append((sent, d, cost, *b))
                mass[b] += math.exp(700 - cost)
        best = {}
        for (_, s, e), w in mass.items():
            best[s, e] = max(best.get((s, e), 0), w / total)

        def trees(s, e):
            if (s, e) in best:
                if e - s == 1:
                    yield best[s, e]
                for m in range(s + 1, e):
                    for x in trees(s, m):
                        for y in trees(m, e):
                            yield best[s, e] + x + y

        expected[sent] = n, max(trees(0, n)), best
    got = defaultdict(list)
    for r in ranking.max_constituents(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.sent].append(r)
    assert set(got) == set(expected)
    for sent, (n, score, best) in expected.items():
        spans = [(r.s, r.e) for r in got[sent]]
        assert len(set(spans)) == len(spans) == 2 * n - 1
        assert abs(sum(best[x] for x in spans) - score) < 1e-6 and abs(got[sent][0].score - score) < 1e-6


def test_nothing_and_no_tree(spark):
    assert ranking.max_constituents(spark.createDataFrame([], SCHEMA)).count() == 0
    lost = [(1, 0, 1.0, "X", 0, 2), (1, 0, 1.0, "a", 0, 1)]
    assert ranking.max_constituents(spark.createDataFrame(lost, SCHEMA)).count() == 0


def test_brackets_meet_once(spark):
    """No join a span length and no table of spans; equal splits, repeated brackets, labels of equal weight."""
    rows = [(1, d, 1.0, "X", 0, 3) for d in (1, 1, 2)] + [(1, 1, 1.0, "Y", 0, 2), (1, 2, 1.0, "Y", 1, 3), (1, 1, 1.0, "Z", 0, 3)]
    rows += [(s, 1, 2.0, label, k, k + 1) for s in (1, 2) for k, label in enumerate("abc"[: 4 - s])] + [(2, 1, 2.0, "V", 0, 2), (2, 1, 2.0, "W", 0, 2)]
    found = ranking.max_constituents(spark.createDataFrame(rows, SCHEMA))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Scan parquet" not in plan
    got = {(r.sent, r.s, r.e): (r.label, r.score) for r in found.collect()}
    # The last split of the sentence is taken; derivation 1 also has the costs of the words.
    assert {k for k in got if k[0] == 1} == {(1, 0, 3), (1, 0, 2), (1, 0, 1), (1, 1, 2), (1, 2, 3)} and got[1, 0, 3][0] == "X"
    assert {k: v[0] for k, v in got.items() if k[0] == 2} == {(2, 0, 2): "W", (2, 0, 1): "a", (2, 1, 2): "b"}
