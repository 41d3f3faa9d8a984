"""Quality rules that vote: expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, WORD, Scratch, n_words

ROUNDS = 30
FIRST = (1.0, 0.1, -2.0)  # where the log odds of good, of a good vote and of a bad vote start
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = "\x20\t\n\x0b\x0c\r"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, whatever the optimiser does."""
    return F.transform(F.array(value), then)[0]


def _covered(starts: Column) -> Column:
    """Words in the 3-word windows that begin at the sorted ``starts``."""
    gap = lambda i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(3)))
    return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0).cast("long"), lambda s, i: s + gap(i))


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash stands in ``hashes`` twice or more."""

    def starts(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: same(i, i + 1) | ((i > 0) & same(i, i - 1)))
        return F.sort_array(F.transform(twice, lambda i: F.get(pairs, i)["at"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return let(let(pairs, starts), _covered)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES (long), n_lines, n_letters and n_upper, a row for each row of ``docs``.

    A null text has no words.  All is computed within a row, without a shuffle; 3-word
    windows of one text are compared by 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    dup_lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(_BLANKS))) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    windows = let(
        F.split(F.trim(text, F.lit(_BLANKS)), f"[{SPACE}]+"),
        lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    )
    repeats = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated(h)).otherwise(F.lit(0).cast("long")))
    return docs.select(
        "doc_id",
        n_words(text).alias("n_words"),
        (F.char_length(text) - count(f"[{SPACE}]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        F.when(F.size(F.split(F.trim(text, F.lit(_BLANKS)), f"[{SPACE}]+", 4)) >= 3, repeats).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        count(r"\p{L}").alias("n_letters"),
        count(r"\p{Lu}").alias("n_upper"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(-1))


def rules() -> list[Column]:
    """Each votes 1 (good), 0 (bad) or -1 (abstains); the thresholds are this module's.

    Faults that texts show plainly have a lax rule and a strict one, and length and repeated
    lines a rule that many good texts break: which votes to believe is left to the model.
    """
    n, c = F.col, lambda name: F.col(name).cast("double")
    words, letters, chars = (F.greatest(c(x), F.lit(1.0)) for x in ("n_words", "n_letters", "word_chars"))
    mean, symbols, repeats = c("word_chars") / words, c("n_symbols") / words, c("n_repeat_words") / words
    upper, lines = c("n_upper") / letters, c("n_dup_lines") / c("n_lines")
    return [
        _vote(n("n_words") >= 200, n("n_words") < 100),
        _vote(mean.between(3.0, 10.0), (mean < 2.0) | (mean > 15.0)),
        _vote(mean.between(4.0, 9.0), (mean < 3.5) | (mean > 10.0)),
        _vote(symbols <= 0.02, symbols > 0.1),
        _vote(c("n_symbols") / chars <= 0.005, c("n_symbols") / chars > 0.03),
        _vote(c("n_letters") / chars >= 0.9, c("n_letters") / chars < 0.8),
        _vote(lines == 0.0, (n("n_dup_lines") >= 3) & (lines > 0.3)),
        _vote(n("n_dup_lines") == 0, n("n_dup_lines") >= 1),
        _vote(repeats <= 0.1, repeats > 0.3),
        _vote(repeats <= 0.05, repeats > 0.2),
        _vote(upper <= 0.15, upper > 0.5),
        _vote(upper <= 0.1, upper > 0.2),
    ]


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """Log odds of good, and for each rule what a good and what a bad vote add to them.

    ``patterns``: votes (array of int) and n, at most 3 ** n_rules rows; one expression runs
    all rounds of expectation-maximisation over them; without rows the model is where it
    starts.  A rule has two accuracies: how often it is right where it votes on good texts,
    a, and on bad texts, b.  A rule may miss most bad texts, as each looks for one fault,
    but never votes bad more often on good texts than on bad ones.  Both are counts of
    texts and of one imagined text on either side, so data move them freely.  At the start
    one bad vote among good ones is forgiven, and two are not.
    """
    if patterns.isEmpty():
        return FIRST[0], [FIRST[1]] * n_rules, [FIRST[2]] * n_rules
    every = f"sequence(0, {n_rules - 1})"
    logit = f"(m.c + aggregate({every}, 0D, (s, j) -> s + CASE p.v[j] WHEN 1 THEN m.g[j] WHEN 0 THEN m.b[j] ELSE 0D END))"
    share = f"transform(t, p -> p.n / (1D + exp(-{logit})))"
    total = lambda what, when="true": f"aggregate(sequence(0, size(t) - 1), 0D, (s, i) -> s + IF({when}, {what}, 0D))"
    right = f"(({total('q[i]', 't[i].v[j] = 1')} + 1D) / ({total('q[i]', 't[i].v[j] >= 0')} + 2D))"
    wrong = f"(({total('t[i].n - q[i]', 't[i].v[j] = 0')} + 1D) / ({total('t[i].n - q[i]', 't[i].v[j] >= 0')} + 2D))"
    odds = f"transform(transform({every}, j -> named_struct('a', {right}, 'b', {wrong})), y -> named_struct('a', y.a, 'b', greatest(y.b, 1D - y.a)))"
    step = (
        f"transform(array({share}), q -> transform(array({odds}), x -> named_struct("
        f"'c', ln(({total('q[i]')} + 1D) / ({total('t[i].n - q[i]')} + 1D)),"
        "'g', transform(x, y -> ln(y.a / (1D - y.b))), 'b', transform(x, y -> ln((1D - y.a) / y.b))))[0])[0]"
    )
    first = f"named_struct('c', {FIRST[0]}D, 'g', array_repeat({FIRST[1]}D, {n_rules}), 'b', array_repeat({FIRST[2]}D, {n_rules}))"
    table = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n")))).alias("t"))
    model = table.select(F.expr(f"aggregate(sequence(1, {rounds}), {first}, (m, r) -> {step})").alias("m")).first()["m"]
    return model["c"], list(model["g"]), list(model["b"])


def judge(measured: DataFrame, min_words: int = 50) -> DataFrame:
    """``measured`` with votes, posterior (probability of good), base_failed and kept."""
    n = len(rules())
    voted = measured.withColumn("votes", F.array(*rules()))
    prior, good, bad = fit(voted.groupBy("votes").agg(F.count("*").alias("n")), n)
    logit = F.lit(prior)
    for j in range(n):
        vote = F.get("votes", F.lit(j))
        logit = logit + F.when(vote == 1, F.lit(good[j])).when(vote == 0, F.lit(bad[j])).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.withColumn("posterior", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, votes, posterior, base_failed and kept for each row of ``docs``.

    Rows with null ids and repeated rows are judged like any other; other columns are not
    read.  Over an empty table the result is empty.
    """
    return judge(Scratch(docs.sparkSession).keep(measure(docs)))


__all__ = ["MEASURES", "WORD", "fit", "judge", "measure", "quality", "rules"]
