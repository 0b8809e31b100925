"""Operator 10: quality rules as weak supervision.

Every rule votes for or against a document or abstains. Nobody says which rules
are right, so expectation-maximisation estimates, from how the votes agree, the
share of good documents and each rule's accuracy on good and on bad ones, how
often it votes for, against or not at all. It looks at all documents that pass the base
test, as the others are settled, and leaves out rules that vote the same everywhere.
A document is kept when the posterior probability that it is good reaches one half; it
may fail a rule and stay.

The rules need one narrow pass over the texts, in DataFrame functions. What the
estimate needs is the number of documents with each pattern of votes: grouped
counts, at most 3 to the power of the number of rules however many documents
there are, and the only thing the driver sees.

Null texts count as empty; an empty text has no words and fails the base test. Very long texts
are read whole, in memory in proportion to their length.
Repeated rows count as often as they occur. An empty table gives an empty table
and the starting accuracies. Only the text is looked at.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import let, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def repeated_words(w: Column) -> Column:
    """Words in ``WINDOW``-word windows found twice or more in the text, the first one included."""
    size = F.size(w)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda e, i: F.coalesce((e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]),
                                                   e["h"] == F.get(s, i - 1)["h"], e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda e: e["i"])), covered)

    def count(win: Column) -> Column:
        placed = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(placed, twice))

    found = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count))
    return F.when(size > WINDOW, found).otherwise(F.lit(0))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of the text, all bigint, that the rules look at."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = df.withColumns({"_words": words(F.col(text)), "_lines": lines})
    measures = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_upper": F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]", "")),
        "n_letters": F.length(F.regexp_replace(whole, r"[^\p{L}]+", "")),
        "n_kinds": F.size(F.array_distinct("_words")),
        "n_marks": F.length(whole) - F.length(F.regexp_replace(whole, "[!?]", "")),
        "n_digits": F.length(whole) - F.length(F.regexp_replace(whole, "[0-9]", "")),
    }
    return first.withColumns({k: v.cast("bigint") for k, v in measures.items()}).drop("_words", "_lines")


#: name: (SQL for a vote that the document is good, SQL for a vote that it is bad); neither is an abstention.
RULES = {
    "length": ("n_words >= 30", "n_words < 10"),
    "word_length": ("word_chars between 3 * n_words and 10 * n_words", "word_chars not between 2 * n_words and 15 * n_words"),
    "symbols": ("n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    "letters": ("n_letters >= 0.9 * word_chars", "n_letters < 0.8 * word_chars"),
    "dup_lines": ("n_dup_lines = 0 and n_lines > 1", "n_dup_lines > 0.5 * n_lines"),
    "repeats": ("n_repeat_words <= 0.05 * n_words", "n_repeat_words > 0.2 * n_words"),
    "variety": ("n_kinds > 0.35 * n_words", "n_words >= 30 and n_kinds < 0.2 * n_words"),
    "capitals": ("n_upper <= 0.15 * word_chars", "n_upper > 0.4 * word_chars"),
    "marks": ("n_marks <= 0.1 * n_words", "n_marks > 0.5 * n_words"),
    "digits": ("n_digits <= 0.05 * word_chars", "n_digits > 0.5 * word_chars"),
}


VOTES = (1, 0, -1)
#: Where the estimate starts, and how many documents' worth of votes hold a rule there: shares of the votes
#: 1, 0 and -1 among good and among bad documents.
START = ((0.80, 0.17, 0.03), (0.50, 0.15, 0.35))
STRENGTH = 50.0
#: A rule is against at most so many good documents and at least so many bad ones; good and bad cannot change places.
MOST_AGAINST_GOOD, LEAST_AGAINST_BAD = 0.02, 0.05


class Accuracies(NamedTuple):
    """Share of good documents, and per rule of ``RULES`` the shares of ``VOTES`` among good and bad ones."""

    good: float
    rates: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]


def with_votes(df: DataFrame) -> DataFrame:
    cast = {k: F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0)) for k, (good, bad) in RULES.items()}
    return df.withColumns({f"vote_{k}": v.cast("int") for k, v in cast.items()})


def odds(model: Accuracies, votes) -> float:
    told = (log(good[VOTES.index(v)] / bad[VOTES.index(v)]) for v, (good, bad) in zip(votes, model.rates, strict=True))
    return log(model.good / (1 - model.good)) + sum(told)


def bounded(rates: list[float], low: float, high: float) -> tuple[float, ...]:
    """The rates with the last one, votes against, held within bounds."""
    against = min(high, max(low, rates[-1]))
    rest = (1 - against) / max(sum(rates[:-1]), 1e-12)
    return (*(max(1e-6, r * rest) for r in rates[:-1]), against)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300) -> Accuracies:
    """Expectation-maximisation over counted vote patterns.

    A rule that votes the same everywhere tells nothing: its rates are the same on both sides.
    """
    total = sum(n for _, n in patterns)
    constant = [len({votes[j] for votes, _ in patterns}) == 1 for j in range(len(RULES))]
    even = (tuple(1 / len(VOTES) for _ in VOTES),) * 2
    model = Accuracies(0.85, (START,) * len(RULES))
    for _ in range(rounds if total else 0):
        sums = [[[STRENGTH * r for r in side] for side in START] for _ in RULES]
        share = [0.85 * STRENGTH, 0.15 * STRENGTH]
        for votes, n in patterns:
            x = odds(model, votes)
            good = n / (1 + exp(-x)) if x > -700 else 0.0
            for side, weight in enumerate((good, n - good)):
                share[side] += weight
                for j, v in enumerate(votes):
                    sums[j][side][VOTES.index(v)] += weight
        rates = tuple(
            even if same else (
                bounded([x / sum(good) for x in good], 1e-4, MOST_AGAINST_GOOD),
                bounded([x / sum(bad) for x in bad], LEAST_AGAINST_BAD, 0.99),
            )
            for same, (good, bad) in zip(constant, sums, strict=True)
        )
        new = Accuracies(share[0] / sum(share), rates)
        still = abs(new.good - model.good) < 1e-9
        model = new
        if still:
            break
    return model


def fit(voted: DataFrame) -> Accuracies:
    """Estimate from the votes of all rows that pass the base test.

    Those that fail it are settled without the estimate and would otherwise be what it takes for bad documents.
    """
    names = [f"vote_{k}" for k in RULES]
    rows = voted.filter(~base_failed()).groupBy(*names).count().orderBy(*names).collect()
    return estimate([(tuple(r[:-1]), r[-1]) for r in rows])


def posterior(model: Accuracies) -> Column:
    """Probability that the document is good, from its vote columns."""
    def told(name: str, good, bad) -> Column:
        weights = [F.lit(log(g / b)) for g, b in zip(good, bad, strict=True)]
        vote = F.col(f"vote_{name}")
        return F.when(vote == VOTES[0], weights[0]).when(vote == VOTES[1], weights[1]).otherwise(weights[2])

    every = (told(k, *rates) for k, rates in zip(RULES, model.rates, strict=True))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, every, F.lit(log(model.good / (1 - model.good))))))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(measured: DataFrame, model: Accuracies) -> DataFrame:
    """Add ``base_failed``, ``posterior`` and ``kept`` to rows with measures."""
    voted = with_votes(measured).withColumns({"base_failed": base_failed(), "posterior": posterior(model)})
    return voted.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
