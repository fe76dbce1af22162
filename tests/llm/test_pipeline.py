from collections import Counter

import corpus_pipeline
from tabulon.llm import mixing, near_dedup, packing, quality_classifier, substring_dedup

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_came_before(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    start, quality, near, passages, mixed, packed = seen
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for df in seen[:-1]:
        assert df.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality_classifier.scored(start, quality_classifier.fit(start, labels))
    assert ids(quality) == ids(scores.where("quality_score >= 0.7"))
    assert ids(near) == ids(near_dedup.near_duplicates(quality).where("kept"))
    assert ids(passages) == ids(near)
    spans = {r["doc_id"] for r in substring_dedup.repeated_passages(near).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (near, passages))
    assert {i for i in before if before[i] != after[i]} == spans
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in mixing.mixed_documents(passages).collect())
    assert ids(mixed) == ids(passages)
    encode = packing.encoder(packing.default_vocabulary())
    assert sum(r["length"] for r in packed.collect()) == sum(len(encode(r["text"] or "")) + 1 for r in mixed.collect())
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_odd_documents(spark, odd, empty):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names go through all stages."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    got = docs.collect()
    assert all(r[c] == "mine" for r in got for c in odd.columns[5:])
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {r["doc_id"] for r in got}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
