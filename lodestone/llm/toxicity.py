"""Toxicity by weak supervision.

1. Lexicons are read off a bounded sample of labelled training documents, each by a rule of
   its own: whole words, beginnings, endings, and families, i.e. beginnings that two or
   three different words of one text share.  An entry must be RATIO times as common in
   toxic texts and pass a likelihood-ratio test; no list has a greatest length.
2. Voters look a document over.  Each kind of list has three: what its entries weigh
   against the length of the text, whether they weigh twice as much, and their density.
   Patterns that know no list vote beside them: repeated words, capitals, exclamation
   marks, symbols and brevity.  Votes are 1 (toxic), 0 and -1 (nothing found).
3. A generative label model, fitted by expectation-maximisation on the votes alone, starts
   where any voter that fires is thought likelier right than wrong.  It estimates how each
   voter votes under either class, and how voters correlate beyond the class; a voter
   counts less the more it repeats others.  What a pattern is worth it finds out here.
4. A linear classifier over lexicon entries and votes learns the posterior labels.

The labels serve step 1 only.  The cluster counts and extracts; the lexicon and the
sample's votes, which the sample bounds, meet on the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean

SAMPLE = 20_000  # labelled documents that a model is fitted on, at most
LENGTHS = (4, 5, 6)  # of beginnings
ENDING = 5
RATIO = 10.0  # how much commoner in toxic texts than in clean ones an entry is
SIGNED_ROOT = 2.5  # of the likelihood ratio that an entry reaches
WEIGHT = 3.5  # evidence (natural logarithms) from which on a list votes
WORDS_A_UNIT = 80  # words of a text that ask for one more unit of evidence
ROUNDS = 40
_WORD = re.compile(r"\w+")
_SYMBOLS = re.compile(r"[#$%&*@]")
_REMEMBERED = 300_000

#: The marks of an entry's list: words, beginnings, endings, families of two, of three.
LISTS = 5
PATTERNS = 5
N_VOTERS = 3 * LISTS + PATTERNS


def list_of(entry: str) -> int:
    """The list that an entry stands in, read off its marks."""
    if entry.startswith("*"):
        return 2
    return {0: 0, 1: 1, 2: 3, 3: 4}[entry.count("*")]


def features_of(word: str) -> list[str]:
    """A word, its beginnings and its ending, with their marks."""
    ending = [f"*{word[-ENDING:]}"] if len(word) > ENDING else []
    return [word, *(f"{word[:k]}*" for k in LENGTHS if len(word) > k), *ending]


def _beginnings(word: str) -> list[str]:
    return [word[:k] for k in LENGTHS if len(word) >= k]


def _features(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    families = Counter(b for w in words for b in _beginnings(w))
    out = {f for w in words for f in features_of(w)}
    out.update(f"{b}**" for b, n in families.items() if n >= 2)
    out.update(f"{b}***" for b, n in families.items() if n >= 3)
    return out


def _patterns(text: str, n_words: int) -> list[int]:
    """Votes that no lexicon has a part in."""
    words = text.split()
    n = max(1, len(words))
    letters = sum(map(str.isalpha, text))
    return [
        int(5 * sum(map(str.__eq__, words, words[1:])) > n),
        int(sum(map(str.isupper, text)) > 0.3 * letters),
        int(20 * text.count("!") > n),
        int(2 * len(_SYMBOLS.findall(text)) > n),
        int(0 < n_words < 20),
    ]


@dataclass
class Model:
    """A fitted model; ``lexicon`` maps an entry to its column, ``evidence`` is by column."""

    lexicon: dict[str, int]
    evidence: list[float]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.lists = [list_of(f) for f in self.lexicon]
        self.known: dict[str, tuple[tuple[int, ...], tuple[str, ...]]] = {}

    def hits(self, text: str) -> tuple[list[int], int]:
        """The columns of the entries in a text, and its number of words."""
        words = _WORD.findall(text.lower())
        known, lexicon, found, families = self.known, self.lexicon, set(), Counter()
        for w in set(words):
            if (c := known.get(w)) is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                c = known[w] = (tuple(lexicon[f] for f in features_of(w) if f in lexicon), tuple(b for b in _beginnings(w) if f"{b}**" in lexicon or f"{b}***" in lexicon))
            if c[0]:
                found.update(c[0])
            if c[1]:
                families.update(c[1])
        for b, n in families.items():
            found.update(lexicon[f] for f in (f"{b}**", f"{b}***")[: max(0, n - 1)] if f in lexicon)
        return sorted(found), len(words)

    def votes(self, text: str, hits: list[int], n_words: int) -> list[int]:
        """1 for toxic, -1 for nothing found, 0 else, of each voter."""
        total, count = [0.0] * LISTS, [0] * LISTS
        for c in hits:
            total[self.lists[c]] += self.evidence[c]
            count[self.lists[c]] += 1
        asked, out = max(WEIGHT, n_words / WORDS_A_UNIT), []
        for weight, n in zip(total, count, strict=True):
            out += [-1 if not n else int(weight >= asked), int(weight >= 2 * asked), int(30 * n >= max(1, n_words))]
        return out + _patterns(text, n_words)

    def score(self, text: str) -> float:
        hits, n = self.hits(text)
        z = self.bias + float(self.weights[hits].sum()) + float(np.dot(self.weights[len(self.lexicon) :], self.votes(text, hits, n)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def ratio_test(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """The signed root of the likelihood ratio of a feature found in so many texts of each kind."""
    n, held = n_toxic + n_clean, toxic + clean
    cells = ((toxic, n_toxic * held), (clean, n_clean * held), (n_toxic - toxic, n_toxic * (n - held)), (n_clean - clean, n_clean * (n - held)))
    root = math.sqrt(max(0.0, 2 * sum(o * math.log(o * n / e) for o, e in cells if o > 0)))
    return root if toxic * n_clean >= clean * n_toxic else -root


def evidence_of(toxic: int, clean: int, n_toxic: int, n_clean: int) -> tuple[float, float]:
    """How much commoner a feature is in toxic texts, as a logarithm, and the same shrunk for
    how few texts say so."""
    ratio = math.log((toxic + 0.25) / (n_toxic + 0.5)) - math.log((clean + 0.25) / (n_clean + 0.5))
    return ratio, ratio * toxic / (toxic + 1)


def first_guess(votes: np.ndarray) -> np.ndarray:
    """The probability of toxic before anything is estimated: a voter that fires says more
    than one that finds nothing."""
    return 1 / (1 + np.exp(1.0 - 2.0 * (votes > 0).sum(1) + 0.25 * (votes < 0).sum(1)))


def label_model(votes: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """The probability of toxic for each row of ``votes``, from a first guess at it.

    Correlations are those of votes around their class's mean; a voter's evidence is
    divided by 1 + the sum of its positive correlations with the other voters.
    """
    n, m = votes.shape
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    q = guess
    for _ in range(ROUNDS):
        prior = (q.sum() + 1) / (n + 2)
        given = [(np.einsum("i,imv->mv", w, onehot) + 0.5) / (w.sum() + 1.5) for w in (q, 1 - q)]
        evidence = np.einsum("imv,mv->im", onehot, np.log(given[0]) - np.log(given[1]))
        mean = [np.einsum("i,im->m", w, votes) / max(w.sum(), 1e-9) for w in (q, 1 - q)]
        rest = votes - np.outer(q, mean[0]) - np.outer(1 - q, mean[1])
        scale = np.sqrt((rest**2).mean(0)) + 1e-9
        tied = np.clip((rest / scale).T @ (rest / scale) / n, 0, 1)
        np.fill_diagonal(tied, 0)
        z = math.log(prior / (1 - prior)) + (evidence / (1 + tied.sum(1))).sum(1)
        q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return q


def linear(columns: list[list[int]], votes: np.ndarray, target: np.ndarray, n_columns: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by accelerated descent."""
    rows = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    cols = np.array([x for c in columns for x in c], np.int64)
    m, n = votes.shape[1], len(columns)
    w, bias = np.zeros(n_columns + m), math.log((target.sum() + 1) / (n - target.sum() + 1))
    speed, push = np.zeros(n_columns + m + 1), 0.9
    for _ in range(rounds):
        z = bias + np.bincount(rows, w[cols], n) + votes @ w[n_columns:]
        gap = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        slope = np.concatenate([np.bincount(cols, gap[rows], n_columns), votes.T @ gap, [gap.sum()]]) / n
        slope[:-1] += 1e-3 * w
        speed = push * speed - 0.3 * slope
        w, bias = w + speed[:-1], bias + speed[-1]
    return w, bias


def held_out(doc_id):
    """Documents whose labels nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            yield part, [t or "" for t in part.column("text").to_pylist()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labels (doc_id, toxic) outside held_out(), from SAMPLE of them at most."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE rows of two numbers: a proven bound.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)

    def counted(rows: DataFrame, only=None) -> DataFrame:
        @lean
        def count(batches):
            counts: Counter = Counter()
            for _, texts in _texts(batches):
                for t in texts:
                    counts.update(_features(t) if only is None else _features(t) & only.value)
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

        return rows.mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    # The fewest toxic texts that pass the test even if no clean one holds the feature.
    least = next((n for n in range(1, n_toxic + 1) if ratio_test(n, 0, n_toxic, n_clean) >= SIGNED_ROOT), n_toxic + 1)
    toxic = {r["feature"]: r["n"] for r in counted(sample.where("toxic = 1")).where(F.col("n") >= least).collect()}
    only = docs.sparkSession.sparkContext.broadcast(set(toxic))
    clean = {r["feature"]: r["n"] for r in counted(sample.where("toxic = 0"), only).collect()}
    lexicon, evidence = {}, []
    for f in sorted(toxic):
        ratio, shrunk = evidence_of(toxic[f], clean.get(f, 0), n_toxic, n_clean)
        if ratio >= math.log(RATIO) and ratio_test(toxic[f], clean.get(f, 0), n_toxic, n_clean) >= SIGNED_ROOT:
            lexicon[f] = len(lexicon)
            evidence.append(shrunk)
    model = Model(lexicon, evidence, np.zeros(len(lexicon) + N_VOTERS), -3.0)

    @lean
    def look(batches):
        for part, texts in _texts(batches):
            hits = [model.hits(t) for t in texts]
            votes = [model.votes(t, h, n) for t, (h, n) in zip(texts, hits, strict=True)]
            yield pa.record_batch([pa.array([h for h, _ in hits], pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32()))], names=["hits", "votes"])
        model.known.clear()

    rows = sample.select("text").mapInArrow(look, "hits array<int>, votes array<int>").collect() if lexicon else []
    if rows:
        rows.sort()  # sums in the same order whichever task came first
        votes = np.array([r["votes"] for r in rows], float)
        model.weights, model.bias = linear([r["hits"] for r in rows], votes, label_model(votes, first_guess(votes)), len(lexicon))
    return model


@lean
def _scores(batches: Iterator[pd.Series], model: Model) -> Iterator[pd.Series]:
    """The scores of a task's texts; the words met are forgotten at its end."""
    for texts in batches:
        yield texts.fillna("").map(model.score)
    model.known.clear()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column score; one of that name is replaced."""
    state = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _scores(batches, state.value)

    return docs.withColumn("score", scores(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` with held_out, score (0 to 1) and predicted (int);
    columns of these names are replaced.

    Only the text is an input of a score: equal texts have equal scores, null is the empty
    text.  A null id is not held out.  Without labels to learn from all scores are low.
    Labels of one id count as toxic if any of them is; rows that share an id share its
    label.  Very long texts are read whole.
    """
    scored = score(docs, fit(docs, labels))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})
