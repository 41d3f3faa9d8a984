"""The pipeline's stages over the smallest tables: what each keeps, and what it gives back."""

from collections import Counter

import corpus_pipeline
from lodestone.llm.minhash_dedup import near_duplicates

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["toxicity"].collect()}
    assert sum(y and i in kept for i, y in labels.items()) <= 0.2 * max(1, sum(labels.values()))
    assert sum(not y and i not in kept for i, y in labels.items()) <= 0.02 * len(labels)
    assert seen["line_dedup"].count() == len(kept)
    once = seen["minhash_dedup"]
    assert near_duplicates(once).where("NOT kept").isEmpty()
    copies = Counter(r["doc_id"] for r in seen["mixing"].collect())
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in once.collect()}
    whole = Counter(r["doc_id"] for r in seen["packing"].where("start = 0").collect())
    assert whole == copies
    assert corpus_pipeline.run(spark, DATA).count() == seen["packing"].count()
