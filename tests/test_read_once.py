"""What is read again and again is made once: rows of the given trees are counted as they are made."""

import pytest

from dendrium.operators import evaluate, fragments, grammar, rewrite
from dendrium.operators.staging import dropped

SCHEMA = "corpus string, sentno long, nid long, parent long, side int, depth int, label string, pos int, word string, prod string"
#: (S (A a) (S (A b) (S (A c) (A d))))
TREE = [
    (0, None, None, 0, "S", None, None, "S A S"), (1, 0, 1, 1, "A", 1, "a", "A =a"), (2, 0, 2, 1, "S", None, None, "S A S"), (3, 2, 1, 2, "A", 2, "b", "A =b"),
    (4, 2, 2, 2, "S", None, None, "S A A"), (5, 4, 1, 3, "A", 3, "c", "A =c"), (6, 4, 2, 3, "A", 4, "d", "A =d"),
]


@pytest.fixture
def counted(spark):
    made = spark.sparkContext.accumulator(0)

    def count(row):
        made.add(1)
        return row

    rows = [("c", s, *r) for s in (1, 2) for r in TREE]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), SCHEMA), made, len(rows)


@pytest.mark.parametrize("what", ["classes", "log_subtrees"])
def test_levels_read_a_written_table(counted, what):
    nodes, made, n = counted
    assert {"classes": fragments.classes, "log_subtrees": grammar.log_subtrees}[what](nodes).count() == n
    assert made.value == n


def test_evaluation_reads_written_trees(counted):
    nodes, made, n = counted
    (a, b) = evaluate.by_sentence(nodes, nodes, evaluate.parameters("")).collect()
    assert a.exact and b.exact and a.matching == 3
    assert made.value == 2 * n  # gold and candidate


def test_each_ancestor_is_written_once(counted, monkeypatch):
    written = []
    staged = rewrite.staged
    monkeypatch.setattr(rewrite, "staged", lambda df: written.append(staged(df)) or written[-1])
    out = rewrite.ancestors(counted[0])
    assert out.count() == 2 * (2 * 1 + 2 * 2 + 2 * 3) == sum(w.count() for w in written)
    dropped(out)
    with pytest.raises(Exception):  # noqa: B017
        out.count()
