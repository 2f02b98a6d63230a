"""The pipeline's stages against plain rules."""

import zlib

import corpus_pipeline
from rollscale.llm import exact, neardup, personal
from rollscale.llm.common import stored

DIRECTORY = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIRECTORY), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == documents.columns
    copies = seen["exact_dedup"]
    assert exact.assign(copies).where("group_size > 1").isEmpty()
    near = seen["minhash_near_dedup"]
    assert neardup.assign(near).where("NOT kept").isEmpty()
    clean = seen["pii"]
    assert clean.count() == near.count()
    found = personal.find(clean)
    assert found.where("n_email + n_ip + n_card + n_phone > 0").isEmpty()
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in clean.collect()}
    assert all(zlib.crc32(p.ids) >= 0 and p.length <= 2048 for p in pieces)


def test_good_documents_stay(spark, documents):
    kept = corpus_pipeline.good_quality(spark, documents, DIRECTORY)
    labels = spark.read.parquet(f"{DIRECTORY}/labels.parquet").where("quality = 1")
    lost = labels.join(documents, "doc_id").join(kept, "doc_id", "left_anti").count()
    assert lost <= 0.03 * labels.count()
