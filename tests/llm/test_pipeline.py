"""The stages, one after the other, and the registered queries of the subpackage."""

import random

import corpus_pipeline
from panelworks.llm.catalogue import load


def test_every_operator_has_a_query():
    queries, oracles = load()
    assert sorted(int(q[2:].split("_")[0]) for q in queries) == list(range(1, 14))
    assert set(oracles) <= set(queries)


def test_stages(spark, documents, tmp_path):
    rng = random.Random(1)
    item = " ".join(rng.choice(["stone", "valley", "bridge", "lantern", "harbour", "willow"]) + str(rng.randint(0, 99)) for _ in range(30))
    leak = spark.createDataFrame([(70, f"the wind over the house and {item} with the water", "en", "s0", 1)], documents.schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents.unionByName(leak)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == documents.columns
        out.write.parquet(path := str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(path)
        seen.append({r[0] for r in docs.select("doc_id").distinct().collect()})
    language, lines, near, benchmark, packing = seen
    assert not language & {50, 51, 52, 53}
    assert lines <= language and near <= lines and not near & {40, 41, 42}
    assert near - benchmark == {70}
    assert packing == benchmark


def test_stages_of_an_empty_table(spark, nothing, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
