"""The pipeline's stages on a small folder: columns stay, decisions take effect, the end is what packing makes of the rest."""

import random
from collections import Counter

import corpus_pipeline
from dendrium.llm import jaccard_join, packing, quality_classifier, quality_rules


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(vocab, k=n)) + "."
    rows = [(i, text(rng.randint(30, 90)), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(200 + i, " ".join("ABC!!" + str(rng.random()) for _ in range(40)), "en", "s0", 1) for i in range(60)]
    rows += [(300 + i, rows[i][1] + " tail", "en", "s1", 1) for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200 or i >= 300), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        new = stage(spark, kept, str(tmp_path))
        assert new.columns == docs.columns, name
        new.write.parquet(str(tmp_path / name.replace(" ", "_")))
        kept = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
    ids = {r.doc_id for r in kept.collect()}
    assert ids == set(range(200))
    mixed = corpus_pipeline.mixing_stage(spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= ids and max(copies.values()) <= 3
    per_doc = Counter(r.doc_id for r in corpus_pipeline.packing_stage(spark, mixed, str(tmp_path)).where("start = 0").collect())
    assert per_doc == copies
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).where("start = 0").collect()) == copies


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram jaccard join", "mixing", "packing"]
    assert all((jaccard_join, packing, quality_classifier, quality_rules))
