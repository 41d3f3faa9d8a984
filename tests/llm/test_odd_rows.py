"""Nulls, very long texts, hot keys, empty tables and clashing names, operator by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import line_dedup, minhash_dedup, mixing, packing, quality_rules, toxicity
from lodestone.llm._common import id_blocks
from lodestone.llm.embedding_dedup import near_vectors
from lodestone.llm.license_scan import TEMPLATES, scan
from lodestone.llm.minhash_dedup import near_duplicates
from lodestone.llm.substring_dedup import dedup_word_windows
from lodestone.llm.suffix_array_dedup import dedup_byte_windows

DOCS = "doc_id long, text string"
CLASH = ["n", "key", "at", "size", "quality", "score", "predicted", "label", "keys", "code", "part", "before", "place", "ids", "copies", "taken", "target", "n_lines", "n_dropped", "rep", "tag", "set", "left", "right", "holder", "line", "h1", "h2", "_block"]


def words(n, seed, vocabulary=100_000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def clashing(df):
    return df.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASH if c not in df.columns))


def sort(rows):
    return sorted(rows, key=repr)


def test_near_copies_of_very_long_texts(spark):
    long = words(1_000_000, 1)
    rows = [(1, long), (2, long + " and a few words more"), (3, words(300_000, 2)), (4, "short text of six words here"), (5, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5} and got[1][0] > 990_000 and got[5][0] == 0


@pytest.mark.parametrize("piece", [1 << 10, 1 << 14, 1 << 23])
def test_blocks_of_a_bucket_in_any_size(spark, monkeypatch, piece):
    """Chains of near copies: components that only strays of a bucket can join."""
    monkeypatch.setattr(minhash_dedup, "PIECE_BYTES", piece)
    monkeypatch.setattr(minhash_dedup, "TILE", 7)
    rows, r = [], random.Random(5)
    for group in range(4):
        w = words(100, group // 2).split()
        for j in range(40):
            w[r.randrange(100)] = f"g{group}-{r.randrange(50)}"
            rows.append((group * 100 + j, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(99)} for i, t in rows}
    name = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            if name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()}
    assert got == name and len(set(name.values())) > 1


def test_blocks_by_bytes_and_null_ids(spark):
    rows = [(i, "x" * (20_000 if i % 10 == 0 else 200)) for i in range(400)] + [(None, f"{i} " * 500) for i in range(60)]
    dealt, last, n = id_blocks(spark.createDataFrame(rows, DOCS).withColumn("text", F.col("text").cast("binary")), 50_000)
    size = {r["_block"]: (r["b"], r["lo"], r["hi"]) for r in dealt.groupBy("_block").agg(F.sum(F.octet_length("text")).alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()}
    assert max(b for b, _, _ in size.values()) < 3 * 50_000 and len(size) > 15 and n > last
    ids = sorted((lo, hi) for block, (_, lo, hi) in size.items() if block < last)
    assert all(a[1] < b[0] for a, b in zip(ids, ids[1:])) and all(lo is None for block, (_, lo, _) in size.items() if block >= last)


def test_null_ids_in_many_blocks_hold_no_smaller_one(spark, monkeypatch):
    from lodestone.llm import _repeats

    monkeypatch.setattr(_repeats, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(_repeats, "MESSAGE", 1)
    passage = words(60, 9)
    rows = [(None, words(40, 100 + i) + " " + passage) for i in range(30)] + [(None, passage)] * 2
    got = dedup_byte_windows(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["n_removed"] == 0 for r in got)
    got = dedup_byte_windows(spark.createDataFrame([*rows, (7, passage)], DOCS)).collect()
    assert sort((r["doc_id"], r["n_removed"] >= len(passage)) for r in got) == sort([(None, True)] * 32 + [(7, False)])
    got = dedup_word_windows(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["n_removed"] == 60 for r in got)


@pytest.mark.parametrize("op", [dedup_word_windows, dedup_byte_windows])
def test_nothing_goes_that_the_solver_does_not_find(spark, monkeypatch, op):
    """With a solver that finds nothing, nothing is removed: copies, passages and hot anchors."""
    from lodestone.llm import _repeats, substring_dedup, suffix_array_dedup

    monkeypatch.setattr(_repeats, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(_repeats, "MESSAGE", 1)
    monkeypatch.setattr(_repeats, "GROUP", 4)
    passage = words(60, 9)
    df = spark.createDataFrame([(i, words(30, i % 20) + " " + passage + " " + words(20, 50 + i % 25)) for i in range(40)], DOCS)
    assert op(df).agg(F.sum("n_removed")).first()[0] > 0
    blind = lambda gram, order, offset, n, weight, values, search: (np.zeros(len(n), np.uint64),) * 2
    monkeypatch.setattr(substring_dedup, "solve_by_automaton", blind)
    monkeypatch.setattr(suffix_array_dedup, "solve_by_radix", blind)
    assert op(df).agg(F.sum("n_removed")).first()[0] == 0


def test_a_line_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "COMMONEST", 1)
    hot, warm = "a line of more than forty characters, everywhere", "another line of over forty characters, in some"
    rows = [(i, f"{hot}\nown {i}\n{warm if i % 10 == 0 else ''}") for i in range(100)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    for i, _ in rows:
        left = ([hot] if i == 99 else []) + [f"own {i}"] + ([] if i % 10 == 0 and i != 90 else [warm if i == 90 else ""])
        assert got[i] == ("\n".join(left), 3 - len(left))


def test_very_long_texts(spark):
    long = "\n".join([words(20, 4)] * 30_000) + "\n" + TEMPLATES["GPL-notice"]
    df = spark.createDataFrame([(1, long), (2, None), (3, "")], DOCS)
    n = len(long.split())
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(df).collect()} == {1: (30_001, 0), 2: (1, 0), 3: (1, 0)}
    assert [r["license"] for r in scan(df).collect() if r["containment"] == 1] == ["GPL-notice"]
    measured = {r["doc_id"]: (r["n_words"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.quality(df).collect()}
    assert measured[1][:2] == (n, 29_999) and measured[1][2] >= 600_000 and measured[2] == measured[3] == (0, 0, 0)
    pieces = packing.pack(df).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 1) == next(p["doc_tokens"] for p in pieces if p["doc_id"] == 1) > n
    mixed = {r["doc_id"]: r["size"] for r in mixing.mix(df.withColumn("source", F.lit("s"))).collect()}
    assert mixed == {1: n, 2: 0, 3: 0}
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(df, labels).collect())


def test_clashing_names(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog " * 8), (2, "Released under the MIT License. # a | b"), (2, None), (None, "a b c")]
    df = spark.createDataFrame(rows, DOCS)
    same = lambda op: sort(tuple(r) for r in op(df).collect()) == sort(tuple(r) for r in op(clashing(df)).collect())
    assert all(same(op) for op in (near_duplicates, scan, quality_rules.quality, packing.pack, dedup_word_windows, dedup_byte_windows))
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.1], 1), (3, None, None)], "vec_id long, embedding array<float>, label int")
    assert sort(tuple(r) for r in near_vectors(vectors).collect()) == sort(tuple(r) for r in near_vectors(clashing(vectors)).collect())


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with labels alone."""
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_of_odd_rows(spark, sf):
    rows = [(1, None, "s"), (2, "", None), (None, "a null id " + words(80, 1), "s"), (4, words(90, 2), "t"), (4, words(90, 2), "t"), (5, words(90, 2) + " x", "t")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(7).cast("long")}))
    docs = docs.withColumn("with.dot", F.lit("dotted"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        out = got.collect()
        assert all(r[c] == f"mine {c}" for r in out for c in CLASH) and all(r["with.dot"] == "dotted" for r in out), name
        kept = sort((r["doc_id"], r["text"]) for r in out)
        if name in ("toxicity", "line_dedup"):
            assert kept == sort(x[:2] for x in rows)
        if name == "minhash_dedup":  # the repeated row is one document, twice there
            assert kept == sort(x[:2] for x in rows[:-1])
        assert stage(spark, docs.limit(0), sf).count() == 0
    pieces = corpus_pipeline.packed(spark, docs, sf).collect()
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces) >= len(rows)
    assert corpus_pipeline.packed(spark, docs.limit(0), sf).count() == 0


def test_quality_weights_of_the_caller(spark):
    rows = [(i, "a b c d e", "s", 100.0 if i < 20 else 0.01 if i < 190 else None) for i in range(200)] + [(1000, "w " * 50, "t", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    got = mixing.mix(df, weights=(1, 40), max_epochs=3, quality="weight").where("source = 's'").collect()
    taken = {r["doc_id"]: r["copies"] for r in got}
    more = [i for i in taken if taken[i] == max(taken.values())]
    assert 0 < len(more) < 200 and sum(i < 20 for i in more) >= min(20, len(more)) - 1
