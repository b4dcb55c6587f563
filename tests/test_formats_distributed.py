"""Readers and writers on files."""

from dendrium.operators import grammar, treequery
from dendrium.sources import formats
from dendrium.streaming import incremental


def test_read_query_and_write(spark, tmp_path):
    lines = ["(S (NP (DT the) (NN cat)) (VP (VBD saw) (NP (DT the) (NN dog))))", "", "(S (NP (NN cats)) (VP (VBP sleep)))"]
    path = tmp_path / "a.mrg"
    path.write_text("\n".join(lines))
    nodes = formats.read_trees(spark, str(path), "bracket").cache()
    assert nodes.where("is_word").count() == 7 and nodes.select("sentno").distinct().count() == 2
    found = {(r.sentno, r.label) for r in treequery.matches(nodes, "NP > S <- NN").collect()}
    assert found == {(1, "NP"), (2, "NP")}
    rules = {(r.lhs, tuple(r.rhs), r.word): r.n for r in grammar.treebank_grammar(grammar.productions(nodes)).collect()}
    assert rules[("NP", ("DT", "NN"), None)] == 2 and rules[("DT", ("Epsilon",), "the")] == 2
    trees = {r.sentno: r.tree for r in formats.trees_of(nodes).collect()}
    assert trees[2] == "(S (NP (NN 0=cats)) (VP (VBP 1=sleep)))"
    formats.write_trees(nodes, str(tmp_path / "out"))
    assert len(spark.read.text(str(tmp_path / "out")).collect()) == 2


def test_export_blocks_and_robust(spark, tmp_path):
    path = tmp_path / "a.export"
    path.write_text("#BOS 1\nis\tVB\t--\t--\t500\nJohn\tNP\t--\t--\t0\nrich\tJJ\t--\t--\t500\n#500\tVP\t--\t--\t0\n#EOS 1\n#BOS 2\nyes\tX\t--\t--\t0\n#EOS 2\n")
    nodes = formats.read_trees(spark, str(path), "export")
    vp = nodes.where("label = 'VP'").first()
    assert vp.leaves == [0, 2] and vp.fanout == 2 and nodes.select("sentno").distinct().count() == 2
    bad = tmp_path / "b.mrg"
    bad.write_text("(S (NP a)\n(S b)\n")
    assert formats.read_trees(spark, str(bad), "bracket", robust=True).select("sentno").distinct().count() == 1


def test_counts_grow_with_a_stream(spark, tmp_path):
    schema = "lhs string, rhs string, word string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("S", "A B", None)] * 2, [("S", "A B", None), ("A", "Epsilon", "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = incremental.grow_grammar(stream, out, str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    got = {(r.lhs, r.rhs, r.word): r.n for r in incremental.grammar_so_far(spark, out).collect()}
    assert got == {("S", "A B", None): 3, ("A", "Epsilon", "a"): 1}
