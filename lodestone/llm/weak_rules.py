"""Quality rules under weak supervision (operator 6, native).

Each rule looks at a document's counts and votes reject (0), abstain (1) or keep (2). Rules overlap on purpose: a
symptom is seen by several rules with thresholds of their own, strict and loose, so a single loose rule can be
wrong. Expectation-maximisation over all documents estimates, without labels, the share of bad documents and each
rule's two accuracies: how often its vote is "reject" on bad and on good documents. An abstention says nothing.
The verdict is the posterior probability of a good document; a lone rejection by a rule that also rejects good
documents is outvoted, several loose ones together reject.

Priors are beta distributions worth ``STRENGTH`` of the table (``PRIOR_BAD``, ``PRIOR_CAUGHT``, ``PRIOR_FALSE``: all they say is
that bad documents are the fewer and that a rule rejects them more often than good ones), so verdicts depend on
shares and a table repeated k times is judged alike. The search starts from the number of rejections.

Counts are SQL expressions over one row, so texts are read once and never shuffled; the narrow table of
counts is kept. Documents with equal votes are one row with a count: at most 3 ^ rules rows, whatever the
corpus. A step of EM is one aggregation over that table: posteriors are a column, sums of them are the next
model, and only those two dozen sums reach the driver.

Three-word windows are compared by 64-bit hash within one text. Defined results: null texts have no words
(all counts 0, base_failed true); null and repeated ids keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, whole_text

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"  # fixed values: the base count's symbols
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOL_RUN = r"[#*$%&|<>]+"
UNLETTERED = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"  # a word without a letter
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs", "n_distinct", "n_symbol_runs", "n_unlettered", "n_stops"
)
MIN_WORDS = 50
STRENGTH, PRIOR_BAD, PRIOR_CAUGHT, PRIOR_FALSE = 0.02, 0.05, 0.3, 0.02
MOST_STEPS, SETTLED = 200, 1e-4
#: (name, reject where, keep where): integer arithmetic on the counts.
RULES = (
    ("symbols", "5 * n_symbols > word_chars", "100 * n_symbols <= word_chars"),
    ("symbols_a_word", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("symbol_runs", "10 * n_symbol_runs > n_words", "100 * n_symbol_runs <= n_words"),
    ("word_length", "word_chars > 7 * n_words OR word_chars < 4 * n_words", "word_chars <= 6 * n_words AND 2 * word_chars >= 9 * n_words"),
    ("unlettered", "5 * n_unlettered > n_words", "20 * n_unlettered <= n_words"),
    ("shouting", "5 * n_capitals > word_chars", "20 * n_capitals <= word_chars"),
    ("exclaiming", "10 * n_bangs > n_words", "50 * n_bangs <= n_words"),
    ("repeated_words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("variety", "5 * n_distinct < 3 * n_words", "10 * n_distinct >= 7 * n_words"),
    ("sentences", "25 * n_stops < n_words OR 4 * n_stops > n_words", "20 * n_stops >= n_words AND 5 * n_stops <= n_words"),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated(words: Column) -> Column:
    """How many words lie in a three-word window that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(own: Column) -> Column:
            twice = F.transform(own, lambda x, k: F.when((x.h == F.get(own, k - 1).h) | (x.h == F.get(own, k + 1).h), x.i))
            places = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
            start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last"))
            return F.aggregate(
                places, start, lambda a, i: F.struct((a.n + i + 2 - F.greatest(a.last, i - 1)).alias("n"), (i + 2).alias("last")), lambda a: a.n
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(placed, count))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(_let(windows, covered))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of COUNTS (long) for every whole text."""
    text = F.col("own_text")
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    by_word = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    found = docs.select(F.col("doc_id"), whole_text().alias("own_text")).select(
        "doc_id",
        by_word.alias("w"),
        by_line.alias("x"),
        (F.length(text) - _removed(text, SPACE)).alias("word_chars"),
        _removed(text, SYMBOLS).alias("n_symbols"),
        _removed(text, CAPITALS).alias("n_capitals"),
        _removed(text, "!").alias("n_bangs"),
        _removed(text, ".?").alias("n_stops"),
        F.regexp_count(text, F.lit(SYMBOL_RUN)).alias("n_symbol_runs"),
        F.regexp_count(text, F.lit(UNLETTERED)).alias("n_unlettered"),
    )
    parts = {"n_words": "w", "n_repeat_words": "w", "n_distinct": "w", "n_lines": "x", "n_dup_lines": "x"}
    return found.select("doc_id", *[F.col(f"{parts[c]}.{c}" if c in parts else c).cast("long").alias(c) for c in COUNTS])


def votes(rules=RULES) -> list[Column]:
    return [F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) for _, bad, good in rules]


#: log odds of a bad document, and for each rule what "reject" and "keep" add to them.
Model = tuple[float, list[tuple[float, float]]]


def _odds(v: Column, model: Model) -> Column:
    """Log odds that a document with these votes is bad. The model is one constant, so every step runs the same code."""
    added = F.array(*[F.array(F.lit(reject), F.lit(0.0), F.lit(keep)) for reject, keep in model[1]])
    return F.aggregate(F.zip_with(v, added, lambda x, w: F.get(w, x)), F.lit(model[0]), lambda a, x: a + x)


def fit(counted: DataFrame, rules=RULES, most_steps: int = MOST_STEPS) -> Model:
    """The model that EM settles on over all rows of ``counted``."""
    patterns = counted.groupBy(F.array(*votes(rules)).alias("v")).agg(F.count("*").cast("double").alias("n"))
    patterns = stored(patterns.coalesce(1), "patterns")  # bounded, see above
    wide = patterns.select("v", "n", *[(F.get("v", F.lit(j)) == 0).cast("double").alias(f"no{j}") for j in range(len(rules))], *[(F.get("v", F.lit(j)) != 1).cast("double").alias(f"said{j}") for j in range(len(rules))])

    def sums(weight: Column) -> list[float]:
        """Of all documents, of the rejecting ones of each rule, of the voting ones of each rule."""
        columns = [F.lit(1.0), *[F.col(f"{c}{j}") for c in ("no", "said") for j in range(len(rules))]]
        return [x or 0.0 for x in wide.withColumn("w", F.col("n") * weight).agg(*[F.sum(F.col("w") * c).alias(str(k)) for k, c in enumerate(columns)]).first()]

    every, m = sums(F.lit(1.0)), len(rules)
    model: Model = (0.0, [(0.0, 0.0)] * m)
    if not every[0]:
        return model  # no rows
    held = STRENGTH * every[0]  # what a prior weighs
    belief = F.greatest(F.least(F.size(F.filter("v", lambda x: x == 0)) / 2, F.lit(1 - STRENGTH)), F.lit(STRENGTH))  # where the search starts
    for _ in range(most_steps):
        bad = sums(belief)
        share = (bad[0] + held * PRIOR_BAD) / (every[0] + held)
        added = []
        for j in range(1, m + 1):
            caught = (bad[j] + held * PRIOR_CAUGHT) / (bad[m + j] + held)
            false = (every[j] - bad[j] + held * PRIOR_FALSE) / (every[m + j] - bad[m + j] + held)
            added.append((log(caught / false), log((1 - caught) / (1 - false))))
        before, model = model, (log(share / (1 - share)), added)
        moved = max(abs(x - y) for a, b in zip([(before[0],), *before[1]], [(model[0],), *added]) for x, y in zip(a, b))
        if moved < SETTLED:
            break
        belief = 1 / (1 + F.exp(-_odds(F.col("v"), model)))
    return model


def posterior(model: Model, rules=RULES) -> Column:
    """Probability that a row of counts is a good document."""
    return 1 / (1 + F.exp(_odds(F.array(*votes(rules)), model)))


def judged(counted: DataFrame, rules=RULES) -> DataFrame:
    """``counted`` (a stored table of counts) with base_failed, probability and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = counted.withColumns({"base_failed": failed, "probability": posterior(fit(counted, rules), rules)})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5))


def op6_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(stored(counts(table(spark, sf_dir, "documents")), "counts"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
