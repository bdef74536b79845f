import uuid

import corpus_pipeline
from relfeat.llm import near_join

from .conftest import shingles_of, words_of

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        assert set(kept[name][1]) <= set(kept[name][0])
    before, after = kept["near_duplicates"]
    groups = {r.doc_id: r.component_id for r in near_join.near_join(spark.createDataFrame([(i, r.text) for i, r in before.items()], "doc_id long, text string")).collect()}
    assert set(after) == {i for i, g in groups.items() if i == g}
    before, after = kept["decontamination"]
    items = [shingles_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {i for i, r in before.items() if not any(len(s & shingles_of(r.text)) >= 0.8 * len(s) for s in items if s)}
    before, after = kept["mixing"]
    assert all(r.taken in (r.size, 2 * r.size) and r.size == len(words_of(before[i].text)) for i, r in after.items())
    assert abs(sum(r.taken for r in after.values()) - 1.5 * sum(len(words_of(r.text)) for r in before.values())) <= max(r.size for r in after.values())


def test_classifiers_reject_what_labels_reject(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for stage, reject in ((corpus_pipeline.keep_quality, "quality = 0"), (corpus_pipeline.keep_harmless, "toxic = 1")):
        left = {r.doc_id for r in stage(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
        bad = {r.doc_id for r in labels.where(reject).collect()}
        good = {r.doc_id for r in labels.where(f"NOT ({reject})").collect()}
        assert len(good & left) >= 0.98 * len(good) and len(bad & left) <= 0.4 * len(bad)


def test_run_writes_and_rereads(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "size", "target", "taken"} <= set(out.columns), uuid.uuid4()
