"""The pipeline's stages on the smallest tables, each against its operator's brute force or own guarantee."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, mixing, near_dedup, pii, quality
from tessera.llm.common import small_batches, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    names = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = (before, docs)
        if k < 4:
            assert docs.columns == names
    before, after = kept["quality classifier"]
    good = {r.doc_id for r in quality.classify(before, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == good
    before, after = kept["minhash near-dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in near_dedup.near_duplicates(before).where("kept").collect()}
    before, after = kept["benchmark decontamination"]
    bench = table(spark, SF, "benchmark")
    hit = {r.doc_id for r in decontaminate.contamination(before, bench).where("contaminated").collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all((r.text != texts[r.doc_id]) == (r.doc_id in hit) for r in after.collect())
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} <= hit
    before, after = kept["pii"]
    assert after.count() == before.count()
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text == pii.masked(texts[r.doc_id]) and r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["mixing"]
    want = {r.doc_id: r.taken for r in mixing.mixture(before).where("taken > 0").collect()}
    assert {r.doc_id: r.w for r in after.groupBy("doc_id").agg(F.sum("words").alias("w")).collect()} == want
    assert corpus_pipeline.run(spark, SF).count() == after.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_arrow_batches_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 2000, 1, 1).select(F.expr("repeat(cast(id as string), 3000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    for stage in [stage for _, stage in corpus_pipeline.STAGES[:4]]:
        spark.conf.unset(name)
        stage(spark, table(spark, SF, "documents"), SF)
        got = texts.mapInArrow(sizes, "size long, n long").collect()
        assert sum(r.n for r in got) == 2000 and max(r.size for r in got) < 5e6  # 20 MB in one batch otherwise
    spark.conf.set(name, "1000000")
    small_batches(spark)
    assert spark.conf.get(name) == "1000000"
    spark.conf.unset(name)
