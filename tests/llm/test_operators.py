"""Each operator against brute force over small tables with nulls, ties, copies and odd texts."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _repeats, license_scan, line_dedup, minhash_dedup, mixing, packing, quality_rules, toxicity
from lodestone.llm.embedding_dedup import near_vectors
from lodestone.llm.minhash_dedup import near_duplicates
from lodestone.llm.substring_dedup import SuffixAutomaton, dedup_word_windows
from lodestone.llm.suffix_array_dedup import dedup_byte_windows, radix_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(7)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "Pé", "ZO", "x", "ß") for b in ("ra", "te", "so", "di", "", "Ü")]


def prose(n, r=rnd):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(seed=3, n=60):
    """Ids with gaps and out of order, copies, near copies, shared passages and lines, nulls."""
    r = random.Random(seed)
    passage, line = prose(60, r), "A Line that Many documents share, long enough to count " + prose(3, r)
    rows = []
    for i in r.sample(range(1000), n):
        kind = r.randrange(8)
        text = prose(r.choice([0, 1, 2, 30, 80, 200]), r)
        if kind == 0 and rows:
            text = rows[-1][1]
        elif kind == 1 and rows and rows[-1][1]:
            w = rows[-1][1].split()
            if w:
                w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 2:
            text = prose(20, r) + " " + passage + "\t" + prose(9, r)
        elif kind in (3, 4):
            text = text + "\n  " + (line if kind == 3 else line.upper()) + " \n" + prose(12, r)
        elif kind == 5:
            text = "!! " * r.choice([3, 200])
        rows.append((i, text))
    rows += [(1001, None), (1002, ""), (1003, " \t\n "), (1004, "one"), (1005, passage * 3), (1006, "\n\n"), (1007, " \x1c   b")]
    return [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def words(t):
    return t.encode().split()


def sha(b):
    return hashlib.sha256(b).hexdigest()


# -- 8 and 9: repeated windows -----------------------------------------------------------


def brute_words(rows, length):
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - length + 1):
            if count[tuple(w[p : p + length])] > 1:
                gone |= set(range(p, p + length))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def brute_bytes(rows, length):
    first = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        b, gone = t.encode(), set()
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (math.inf if i is None else i):
                gone |= set(range(p, p + length))
        spans = sum(1 for j in gone if j - 1 not in gone)
        out.append((i, len(b), len(gone), spans, bytes(x for j, x in enumerate(b) if j not in gone)))
    return out


def sort(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("block", "group"), [(1 << 22, 256), (3000, 256), (3000, 1)])
def test_repeated_windows(spark, docs, monkeypatch, block, group):
    monkeypatch.setattr(_repeats, "GROUP", group)
    monkeypatch.setattr(_repeats.remove_repeats, "__defaults__", (block,))
    repeated = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    for df in (docs, repeated.withColumn("_block", F.lit(1)).withColumn("kept", F.lit("x"))):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        got = dedup_word_windows(df, 35).collect()
        assert sort((r["doc_id"], r["n_tokens"], r["n_removed"], bytes(r["kept"])) for r in got) == sort(brute_words(rows, 35))
        got = dedup_byte_windows(df, 50).collect()
        assert sort((r["doc_id"], r["n_tokens"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sort(brute_bytes(rows, 50))


def test_repeated_windows_of_nothing(empty):
    assert dedup_word_windows(empty).count() == 0 and dedup_byte_windows(empty).count() == 0


def test_long_periodic_texts(spark):
    rows = [(1, "ab " * 60_000), (2, "ab " * 200), (3, "x" * 70_000), (4, "x" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_byte_windows(df).collect()
    assert sort((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 600), (3, 0), (4, 60)]
    got = dedup_word_windows(df).collect()
    assert sort((r["doc_id"], r["n_removed"]) for r in got) == [(1, 60_000), (2, 200), (3, 0), (4, 0)]


def test_suffix_automaton_counts_and_lengths():
    r = random.Random(1)
    for _ in range(60):
        seqs = [[r.randrange(3) for _ in range(r.randrange(1, 14))] for _ in range(r.randrange(1, 5))]
        a = SuffixAutomaton()
        for s in seqs:
            a.add(s)
        a.finish()
        occurs = Counter(tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        probe = [r.randrange(4) for _ in range(20)]
        for end, (size, count) in enumerate(a.statistics(probe, 5), 1):
            best = max((n for n in range(0, 6) if n <= end and (n == 0 or tuple(probe[end - n : end]) in occurs)), default=0)
            assert size == best and (best == 0 or count == occurs[tuple(probe[end - best : end])])


def test_radix_groups():
    flat = np.frombuffer(b"abcabcabdabcabcabz" * 3, np.uint8)
    start = np.arange(len(flat) - 11)
    left, group = radix_groups(flat, start, np.zeros(len(start), int), 11)
    windows = [flat[s : s + 11].tobytes() for s in start]
    assert {frozenset(left[group == g].tolist()) for g in set(group.tolist())} == {frozenset(i for i, w in enumerate(windows) if w == x) for x, n in Counter(windows).items() if n > 1}


# -- 3: lines ----------------------------------------------------------------------------


def test_lines(docs):
    rows = texts(docs)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for i, t in rows.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    want = {}
    for i, t in rows.items():
        kept = [x for x in t.split("\n") if len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])]
        want[i] = (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))
    got = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("clash")).withColumn("at", F.lit(1)))
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()} == want
    assert sum(v[1] for v in want.values()) > 3 and got.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "n_lines", "at", "n_dropped"]


def test_lines_with_null_and_repeated_ids(spark, empty):
    line = "x" * 40
    rows = [(1, line), (1, line), (2, line), (3, line), (4, line + "\nB"), (5, line), (5, line + "\nC"), (None, "A\n" + line), (None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sort((r["doc_id"], r["text"]) for r in got) == sort([(1, ""), (1, ""), (2, ""), (3, ""), (4, "B"), (5, line), (5, line + "\nC"), (None, "A"), (None, None)])
    assert line_dedup.dedup_lines(empty).count() == 0


# -- 2: near duplicates ------------------------------------------------------------------


def shingle_set(t, k):
    w = t.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes, linked):
    name = {i: i for i in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return name


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    r = random.Random(11)
    rows = [(x[0], x[1]) for x in corpus(5, 80)]
    base = prose(120, r).split()
    for j in range(60):  # a group of near copies, many of them linked only through others
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.randrange(9)}"
        rows.append((2000 + j, " ".join(w)))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    sets = {i: shingle_set(t or "", width) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    linked = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, linked)
    got = near_duplicates(df, width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(got) == len(rows)


def test_near_duplicates_of_odd_rows(spark, empty):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "A B C"), (7, None), (8, "")], "doc_id long, text string")
    got = sort((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df, 2).collect())
    assert got == sort([(None, None, True), (4, 4, True), (4, 4, True), (9, 4, False), (7, 7, True), (8, 8, True)])
    assert near_duplicates(empty).count() == 0


def test_min_max_signature_is_unbiased():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for shared in (200, 500, 800):
        got = []
        for i in range(40):
            p = rng.permutation(pool)
            a, b = p[:1000], np.concatenate([p[:shared], p[1000 : 2000 - shared]])
            got.append((minhash_dedup.signature(a) == minhash_dedup.signature(b)).mean())
        assert abs(np.mean(got) - shared / (2000 - shared)) < 0.03


# -- 5: vectors --------------------------------------------------------------------------


def test_near_vectors(spark):
    r = np.random.default_rng(2)
    rows, centre = [], r.standard_normal((6, 24))
    for i in r.permutation(300).tolist():
        v = centre[i % 6] + r.standard_normal(24) * r.choice([0.1, 0.3, 0.9])
        rows.append((i, [float(x) for x in v], i % 3 if i % 50 else None))
    rows += [(400 + j, rows[0][1], rows[0][2]) for j in range(30)] + [(500, [2 * x for x in rows[0][1]], rows[0][2])]
    rows += [(600, None, 1), (601, [0.0] * 24, 1), (602, [float("nan")] * 24, 1), (603, [None] * 24, 1), (604, [float("inf")] * 24, 1), (605, [1.0], 1), (606, [2.0], 1), (607, [], 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(v), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    linked = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93]
    name, n = components([i for i, _, _ in rows if i is not None], linked), Counter(x for p in linked for x in p)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert len(got) == len(rows) and got.pop(None) == (0, None, True)
    assert got == {i: (n[i], c, c == i) for i, c in name.items()} and len(linked) > 500
    assert near_vectors(df.limit(0)).count() == 0


def test_near_vectors_in_blocks(spark, monkeypatch):
    import lodestone.llm.embedding_dedup as e

    monkeypatch.setattr(e, "BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.ones(16) + r.standard_normal(16) * 0.2], 1) for i in range(120)]
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    n = Counter(x for a in good for b in good if a < b and good[a] @ good[b] >= 0.93 for x in (a, b))
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: n[i] for i in good}


# -- 1: mixing ---------------------------------------------------------------------------


def water(sizes, weights):
    target, left, budget = {}, set(sizes), sum(sizes.values())
    while True:
        total = sum(weights[s] for s in left)
        over = {s for s in left if budget * weights[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: budget * weights[s] / total for s in left}
        for s in over:
            target[s] = 3 * sizes[s]
            budget -= 3 * sizes[s]
        left -= over


def test_mixing(spark, docs, empty):
    more = docs.unionByName(docs.where("doc_id < 300").withColumn("source", F.lit("s9"))).withColumn("taken", F.lit("clash"))
    got = mixing.mix(more).collect()
    size = Counter()
    for r in got:
        assert r["size"] == len(words(r["text"] or "")) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
    order = sorted(s for s in size if s is not None) + [None]
    want = water(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in size)
    again = mixing.mix(more.repartition(7)).collect()
    assert sort((r["doc_id"], r["source"], r["taken"]) for r in got) == sort((r["doc_id"], r["source"], r["taken"]) for r in again)
    assert mixing.mix(empty).count() == 0


def test_mixing_of_copies_and_nothing(spark):
    same = spark.createDataFrame([(1, "a b", "s")] * 10 + [(2, "c " * 40, "t")] + [(None, None, "u"), (3, "", None)], "doc_id long, text string, source string")
    got = mixing.mix(same).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    target = {r["source"]: r["target"] for r in got}
    assert abs(taken["s"] - target["s"]) <= 1 and target["u"] == 0 and target[None] == 0


# -- 7: quality --------------------------------------------------------------------------


def measures(t):
    w, lines = words(t), [x for x in t.split("\n") if x.encode().split()]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))


def test_quality(spark, docs, empty):
    odd = spark.createDataFrame([(5001, "a b c a b c a\nx | y\nx | y\n" * 3), (5002, "é # % & é"), (5002, "a b"), (None, "a b c")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd)
    got = quality_rules.quality(df).collect()
    want = sort((r["doc_id"], *measures(r["text"] or "")) for r in df.collect())
    assert sort((r["doc_id"], *(r[m] for m in quality_rules.MEASURES)) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["posterior"] <= 1
    assert quality_rules.quality(empty).count() == 0


def test_expectation_maximisation(spark):
    r = np.random.default_rng(3)
    good = r.random(4000) < 0.8
    accuracy = [0.95, 0.8, 0.7, 0.6]
    votes = [[-1 if r.random() < 0.2 else int(g == (r.random() < a)) for a in accuracy] for g in good]
    n = Counter(map(tuple, votes))
    prior, up, down = quality_rules.fit(spark.createDataFrame([(list(v), c) for v, c in n.items()], "votes array<int>, n long"), 4)
    c, g, b = quality_rules.FIRST[0], [quality_rules.FIRST[1]] * 4, [quality_rules.FIRST[2]] * 4
    for _ in range(quality_rules.ROUNDS):  # the same rounds in plain Python
        q = {v: k / (1 + math.exp(-(c + sum(g[j] if x == 1 else b[j] if x == 0 else 0 for j, x in enumerate(v))))) for v, k in n.items()}
        c = math.log((sum(q.values()) + 1) / (sum(n.values()) - sum(q.values()) + 1))
        right = [(sum(q[v] for v in n if v[j] == 1) + 1) / (sum(q[v] for v in n if v[j] >= 0) + 2) for j in range(4)]
        bad = {v: n[v] - q[v] for v in n}
        wrong = [(sum(bad[v] for v in n if v[j] == 0) + 1) / (sum(bad[v] for v in n if v[j] >= 0) + 2) for j in range(4)]
        wrong = [max(y, 1 - x) for x, y in zip(right, wrong)]
        g, b = [math.log(x / (1 - y)) for x, y in zip(right, wrong)], [math.log((1 - x) / y) for x, y in zip(right, wrong)]
    assert prior == pytest.approx(c) and up == pytest.approx(g) and down == pytest.approx(b)


def test_weak_bad_votes_are_outvoted(spark):
    """Not the filter that all rules must pass: one weak fault is forgiven, and bad texts go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.quality(docs).where("NOT base_failed").withColumn("n_bad", F.size(F.filter("votes", lambda v: v == 0)))
    rows = judged.join(labels.select("doc_id", "quality"), "doc_id", "left").groupBy("n_bad", "kept", "quality").count().collect()
    total = lambda test: sum(r["count"] for r in rows if test(r))
    assert total(lambda r: r["n_bad"] == 1 and r["kept"]) > 1000 and total(lambda r: r["n_bad"] and not r["kept"]) > 500
    assert total(lambda r: r["quality"] == 1 and r["kept"]) >= 0.99 * total(lambda r: r["quality"] == 1)
    assert total(lambda r: r["quality"] == 0 and r["kept"]) <= 0.01 * total(lambda r: r["quality"] == 0)


def test_a_rule_that_fires_on_good_texts_loses_its_say(spark):
    """Two rules that agree on bad texts, and one that fires on half of all texts."""
    votes = {(1, 1, 1): 500, (1, 1, 0): 500, (0, 0, 1): 40, (0, 0, 0): 40}
    prior, up, down = quality_rules.fit(spark.createDataFrame([(list(v), c) for v, c in votes.items()], "votes array<int>, n long"), 3)
    logit = {v: prior + sum(up[j] if x else down[j] for j, x in enumerate(v)) for v in votes}
    assert {v: z >= 0 for v, z in logit.items()} == {v: v[0] == 1 for v in votes}


# -- 4: toxicity -------------------------------------------------------------------------


def test_toxicity(spark, empty):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        bad = r.random() < 0.15
        w = prose(r.randrange(5, 150), r).split()
        for _ in range(r.randrange(1, 4) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["Blorgh", "wretchling", "snarf" + r.choice("abcdefgh"), "gnashed!"]))
        rows.append((i, " ".join(w), "en", "s", 0, "mine"))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, DOCS + ", score string")
    lab = spark.createDataFrame(labels + [(0, labels[0][1]), (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, lab).collect()}
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    hit = sum(p and y for p, y in held)
    assert hit >= 0.9 * sum(y for _, y in held) and hit >= 0.9 * sum(p for p, _ in held)
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, flipped).collect()} == {i: r["score"] for i, r in got.items()}
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "Blorgh"), (2, "Blorgh")], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.toxicity(odd, lab).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert toxicity.toxicity(empty, lab).count() == 0 and toxicity.toxicity(odd, lab.limit(0)).where("predicted = 1").count() == 0


def test_label_model_discounts_copies():
    r = np.random.default_rng(1)
    y = r.random(6000) < 0.3
    voter = lambda accuracy: np.where(r.random(6000) < accuracy, y, ~y) * 2 - 1
    one, others = voter(0.7), [voter(0.85), voter(0.85)]
    votes = np.stack([one] * 3 + others, 1).astype(float)
    q = toxicity.label_model(votes, 0.5 + 0.4 * (votes.mean(1)))
    split = (one == 1) & (others[0] == -1) & (others[1] == -1)
    assert q[split].mean() < 0.5  # three copies of a weak voter don't outvote two better ones
    assert ((q > 0.5) == y).mean() > 0.85


def test_patterns_vote_without_a_lexicon():
    none = toxicity.Model({}, [], np.zeros(toxicity.N_VOTERS), 0.0)
    fires = lambda t: [i for i, v in enumerate(none.votes(t, *none.hits(t))[-toxicity.PATTERNS :]) if v]
    filler = prose(40)
    assert fires("no " * 30) == [0] and fires("ABC DEF " * 15) == [1] and fires("a b! " * 15) == [2] and fires("#a #b " * 30) == [3] and fires("a b") == [4]
    assert fires("") == [] and fires(filler.lower()) == []


@pytest.mark.parametrize(("sf", "least"), [("sf0.1", 0.9)])
def test_toxicity_of_held_out_documents(spark, sf, least):
    """Recall and precision on labels that nothing was learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert n.get((1, 1), 0) >= least * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.02 * (n.get((0, 1), 0) + n.get((0, 0), 0))


# -- 10: packing -------------------------------------------------------------------------


def test_packing(spark, docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    odd = spark.createDataFrame([(7001, "It's <|endoftext|>x naïve Ünï 12345 日本語 é"), (7001, "twice"), (None, None)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd)
    ids = {(r["doc_id"], r["text"]): [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    window = 64
    pieces = packing.pack(df.repartition(5), window).collect()
    by = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    place = 0
    for p in by:
        assert p["sequence_id"] == place // window and p["offset"] == place % window and 0 < p["length"] <= window - p["offset"]
        place += p["length"]
    assert place == sum(r["n"] for r in [{"n": len(ids[(r["doc_id"], r["text"])])} for r in df.collect()])
    want = Counter()
    for key, x in ids.items():
        want[(key[0], len(x))] += 1
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == want
    for p in pieces:
        some = [x[p["start"] : p["start"] + p["length"]] for k, x in ids.items() if k[0] == p["doc_id"] and len(x) == p["doc_tokens"]]
        assert p["ids_crc32"] in {zlib.crc32(np.array(s, "<u4").tobytes()) for s in some}
    assert packing.pack(empty).count() == 0


# -- 6: licenses -------------------------------------------------------------------------


def brute_licenses(text, templates, share=0.8, width=3, step=lambda most: most):
    fold = lambda t: t.encode().translate(license_scan._FOLD).split()
    out = {}
    for name, body in templates.items():
        w = fold(body)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        most, d = 1 << (len(own) - 1).bit_length(), fold(text)
        s = [tuple(d[i : i + 5]) for i in range(len(d) - 4)]
        for low in range(0, len(s), step(most)):
            found = len(own & set(s[low : low + width * most])) / len(own)
            if found >= share - 1e-9:
                out[name] = max(out.get(name, 0), found)
    return out


def test_licenses(spark, docs, empty):
    r = random.Random(21)
    rows = []
    for i in range(150):
        w = prose(r.randrange(0, 90), r).split()
        for _ in range(r.randrange(4)):
            t = r.choice(list(license_scan.TEMPLATES.values())).split()
            if r.random() < 0.4:
                t[r.randrange(len(t))] = "other"
            for _ in range(r.randrange(12) if r.random() < 0.3 else 0):
                t.insert(r.randrange(len(t)), "inserted")
            at = r.randrange(len(w) + 1)
            w[at:at] = t if r.random() < 0.7 else [x.upper() for x in t]
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (None, license_scan.TEMPLATES["MIT"]), (202, "filler " * 30_000 + license_scan.TEMPLATES["GPL-3.0"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(i, n): round(c, 9) for i, t in rows for n, c in brute_licenses(t or "", license_scan.TEMPLATES).items()}
    got = {(r["doc_id"], r["license"]): round(r["containment"], 9) for r in license_scan.scan(df).collect()}
    assert got == want and len(want) > 60
    anywhere = {(i, n) for i, t in rows if i != 202 for n in brute_licenses(t or "", license_scan.TEMPLATES, width=2, step=lambda most: 1)}
    assert anywhere <= set(got)  # windows of 2 M at every offset lie whole in one of 3 M
    assert license_scan.scan(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan.Library({"short": "too few words"})
