"""Rows that share an id but not the content are rows of their own."""

import corpus_pipeline
from lodestone.llm.embedding_dedup import near_vectors
from lodestone.llm.minhash_dedup import near_duplicates

WORDS = [f"w{i}" for i in range(400)]
T, U = " ".join(WORDS[:100]), " ".join(WORDS[200:300])
NEAR = " ".join([*WORDS[:99], "changed"])


def sort(rows):
    return sorted(rows, key=repr)


def test_one_id_with_two_texts(spark):
    rows = [(3, NEAR), (5, T), (5, U), (9, U + " more"), (8, " ".join(WORDS[300:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sort((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == sort([(3, 96, 3, True), (5, 96, 3, False), (5, 96, 5, True), (9, 97, 5, False), (8, 96, 8, True)])
    left = corpus_pipeline.without_near_copies(spark, df, "").collect()
    assert sort(tuple(r) for r in left) == sort([rows[0], rows[2], rows[4]])


def test_one_id_with_two_vectors(spark):
    a, near, b = [1.0] * 8, [1.0] * 7 + [1.1], [1.0, -1.0] * 4
    rows = [(3, a, 1), (5, near, 1), (5, b, 1), (5, near, 2), (9, [2 * x for x in b], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sort(tuple(r) for r in got.collect()) == sort([(3, 1, 3, True), (5, 1, 3, False), (5, 1, 5, True), (5, 0, 5, True), (9, 1, 5, False)])
