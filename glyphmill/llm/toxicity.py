"""Operator 7: toxicity by class-conditional Kneser-Ney language models.

Two models, one of toxic and one of ordinary texts, give every word a likelihood. A class's
estimate is its count less a discount, which is estimated from the counts of counts of the class
(three discounts, for one, two and more occurrences); what is taken off goes to one distribution
that both classes share, where a word counts, after Kneser and Ney, by the different words that it
follows. So a rare expression has the same backing in both models and says little, and a word of one
fixed phrase is no likelier elsewhere.

Above the words stand the bigrams of each class, less discounts of their own; what a context gives up goes to the
class's estimate of the word alone. How much likelier the word before makes each word in one class than in the other is a
second evidence, its mean per word. It has a slope of its own, 0 where it does not make the curve's texts likelier, as bigrams
of few texts are easily learnt by heart.

A toxic text is ordinary prose with a few toxic words in it. A text is scored by what both
models say per word: the log of the mean ratio of the two likelihoods, which those few words decide, less
the mean of its log, which is what topic and language contribute everywhere, ``TOPIC`` at most. A
logistic curve of this and of what the bigrams add makes a probability.

Words are runs of letters and digits, A-Z in lower case; the first follows a mark
of the start. All words and bigrams of the labelled texts are counted and kept in written tables, without a limit to their
number. The most frequent, ``HEAD`` words and ``PAIRS`` bigrams at most, go to all tasks; texts with words or bigrams that may
be among the rest meet the whole tables in joins.
Training texts meet their labels in one join and are counted in Spark; the
models come from folds other than the curve's.

Null texts count as empty, which score like a text without any evidence. A label
other than 0 and 1, or none, leaves a row out of the training. Rows of one doc_id
that occurs several times count each. Without training rows all scores are the
base rate, which is then one half. Very long texts are hashed whole, in memory in proportion to
their length. Further columns are not read.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.collocations import filter_of, has
from glyphmill.llm.common import sliced
from glyphmill.llm.hashing import NOT_WORD, mix, word_hashes
from glyphmill.session import discard, materialise

#: Words that go to all tasks at most, and bigrams with their contexts; the rest of them is met by joins.
HEAD, PAIRS = 1 << 22, 1 << 21
#: Occurrences up to which entries are told apart when the most frequent ones are picked.
OFTEN = 256
#: Parts at most in which the rest is met, one after another, so that only one part's shuffle is on the disks; rows of a full part.
SLICES, SLICE = 6, 1 << 21
#: Parts of the texts that meet the rest, one after another, so that only one part's open words and bigrams are on the disks.
TEXT_PARTS = 2
#: What stands before the first word of a text.
START = np.uint64(0)
#: Log ratio that one word says at most.
MOST = 8.0
#: Mean log ratio that topic and language account for at most; beyond it the words themselves are toxic.
TOPIC = 1.0
#: What an unseen word counts in the shared distribution, in different words before it.
UNSEEN = 0.5
#: Counted entries that a task holds before it hands them on.
FLUSH = 400_000
THRESHOLD = 0.3
#: Values of crc32(doc_id) mod 4: held out; for the curve; the rest train the models.
HELD_OUT, CURVE = 2, 3
#: Cells of the curve's histogram, and the evidence that they span; the same of what bigrams add, on either side of 0.
CELLS, SPAN = 4000, MOST
CONTEXT_CELLS, CONTEXT_SPAN = 80, 2.0


class Table(NamedTuple):
    """The most frequent entries of a table of gains, and a filter of the others."""

    keys: np.ndarray  # sorted
    gain: np.ndarray  # by key, and last what an entry that the table lacks adds
    rest: np.ndarray | None  # bits by the leading bits of the keys; None if there are no others

    def look(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gain, whether it is among the most frequent, and whether it may be among the others."""
        at = index_of(self.keys, values)
        here = at < len(self.keys)
        other = np.zeros(len(values), bool) if self.rest is None else ~here & has(self.rest, values)
        return self.gain[at], here, other


class Trained(NamedTuple):
    head: Table  # log p(word | toxic) - log p(word | ordinary)
    words: DataFrame  # key and gain of all words of the training texts
    unknown: float  # gain of any other word
    pair_head: Table  # what a bigram adds to its word's gain beyond its context, and what the context adds
    pairs: DataFrame  # the same for all bigrams and contexts; any other adds nothing
    shared: Broadcast  # both heads; sent once, as every copy takes disk
    curve: tuple[float, float, float]  # slopes of the evidence and of what bigrams add, and offset


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def index_of(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values in a sorted table; its length for those it lacks."""
    if len(table) == 0:
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, len(table))


def pair_hash(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(left + np.uint64(1)) + word)


def bigram_keys(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word with the one before it, that one, and the word."""
    left = np.concatenate([[START], w[:-1]]).astype(np.uint64)[: len(w)]
    return pair_hash(left, w), left, w


def counted(texts: DataFrame, keys, columns: tuple[str, ...] = ("key",)) -> DataFrame:
    """(*columns, n0, n1): how often ``keys(word hashes)`` gives each key in the texts of each class.

    With other ``columns`` than the key, ``keys`` gives the keys and these columns, which follow from them.
    """
    names, alone = [*columns, "toxic", "n"], columns == ("key",)

    def run(batches):
        held: list[list[tuple[np.ndarray, ...]]] = [[], []]

        def out():
            for toxic in (0, 1):
                if held[toxic]:
                    found = [np.concatenate(c) for c in zip(*held[toxic], strict=True)]
                    held[toxic].clear()
                    _, first, n = np.unique(found[0], return_index=True, return_counts=True)
                    arrays = [pa.array(c[first].view(np.int64)) for c in (found if alone else found[1:])]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(n), toxic, np.int32)), pa.array(n.astype(np.int64))], names=names)

        size = 0
        for batch in sliced(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = keys(word_hashes((text or "").encode().lower(), NOT_WORD))
                held[toxic].append((found,) if alone else found)
                size += len(held[toxic][-1][0])
            if size > 10 * FLUSH:
                yield from out()
                size = 0
        yield from out()

    schema = ", ".join([*[f"{c} long" for c in columns], "toxic int", "n long"])
    return texts.select("text", "toxic").mapInArrow(run, schema).groupBy(*columns).agg(
        *[F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(f"n{t}") for t in (0, 1)]
    )


def head(table: DataFrame, total: int, unlisted: float, most: int) -> Table:
    """``table`` (key, gain, n) for all tasks, ``most`` entries of it at most; its n sum up to ``total`` at most."""
    sizes = {r["t"]: r["count"] for r in table.groupBy(F.least("n", F.lit(OFTEN)).alias("t")).count().collect()}
    least, listed = max(OFTEN, total / most), 0
    for t in range(OFTEN, 0, -1):
        listed += sizes.get(t, 0)
        if listed > most:
            break
        least = t
    often = F.col("n") >= least
    rows = table.filter(often).select("key", "gain").toArrow()
    key, gain = rows.column("key").to_numpy().astype(np.int64).view(np.uint64), rows.column("gain").to_numpy().astype(float)
    order = np.argsort(key)
    rest = filter_of(table.filter(~often).select(F.col("key").alias("fp")))
    return Table(key[order], np.append(gain[order], unlisted), rest if rest.any() else None)


def discounts(once: int, twice: int, thrice: int, four: int) -> tuple[float, float, float]:
    """Discounts for one, two, and three or more occurrences, after Chen and Goodman, from how many words occur so often."""
    n = (once, twice, thrice, four)
    if not all(n):
        return 0.5, 0.75, 1.0  # too few words to tell
    y = once / (once + 2 * twice)
    return tuple(min(k - 0.01, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))


def class_pairs(texts: DataFrame) -> DataFrame:
    """(left, word, n0, n1): occurrences of each bigram by class."""
    return counted(texts, bigram_keys, ("left", "word"))


def continuations(texts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(key, n0, n1, lefts): occurrences of each word by class, and the different words before it in both.

    ``pairs`` are the bigrams of the texts where they have been counted already; they are the order above the words.
    """
    pairs = class_pairs(texts) if pairs is None else pairs
    return pairs.groupBy(F.col("word").alias("key")).agg(*[F.sum(c).alias(c) for c in ("n0", "n1")], F.count("*").alias("lefts"))


def counts_of_counts(table: DataFrame, *more: Column):
    """Row of ``more`` and, for n0 and n1, the sum, how many entries have 1 to 4 (``n0_1``) and how many have over 2 (``n0_more``)."""
    each = [F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in ("n0", "n1") for k in (1, 2, 3, 4)]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1")]
    return table.agg(*sums, *more, *each, *[F.count_if(F.col(c) > 2).alias(f"{c}_more") for c in ("n0", "n1")]).first()


def taken_off(c: str, d: tuple[float, float, float]) -> Column:
    """The discount of a count ``c``."""
    return F.when(F.col(c) > 2, d[2]).when(F.col(c) == 2, d[1]).when(F.col(c) == 1, d[0]).otherwise(0.0)


def estimates(words: DataFrame) -> tuple[DataFrame, float, int]:
    """(key, gain, n, log0, log1) of each word, its logs of both likelihoods last; the gain of any other word; and the sum of n."""
    sums = counts_of_counts(words, F.coalesce(F.sum("lefts"), F.lit(0)).alias("lefts"), F.count("*").alias("kinds"))
    shared = (F.col("lefts") + UNSEEN) / (sums["lefts"] + UNSEEN * (sums["kinds"] + 1))
    logs, back = [], []
    for c in ("n0", "n1"):
        d = discounts(*[sums[f"{c}_{k}"] for k in (1, 2, 3, 4)])
        given = d[0] * sums[f"{c}_1"] + d[1] * sums[f"{c}_2"] + d[2] * sums[f"{c}_more"]
        # A class without training words has no estimate of its own and takes the shared one whole.
        back.append(max(given / sums[c], 1e-9) if sums[c] else 1.0)
        logs.append(F.log((F.col(c) - taken_off(c, d)) / max(sums[c], 1) + back[-1] * shared))
    n = (F.col("n0") + F.col("n1")).alias("n")
    out = words.select("key", (logs[1] - logs[0]).alias("gain"), n, logs[0].alias("log0"), logs[1].alias("log1"))
    return out, float(np.log(back[1] / back[0])), sums["n0"] + sums["n1"]


def bounded(gain: Column) -> Column:
    return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), gain))


def higher_order(pairs: DataFrame, words: DataFrame) -> tuple[list[DataFrame], int]:
    """Tables (key, gain, n) that hold every bigram and every context, and the sum of n; ``words`` as ``estimates`` gives them.

    A word's likelihood after a context is the bigram's discounted share of the context, and what the context gave up
    times the likelihood of the word alone. Its log ratio, less that of the word alone, is the gain of the context, which is all
    an unseen bigram has, plus that of the bigram.
    """
    sums = counts_of_counts(pairs, F.count("*").alias("kinds"))
    offs = [taken_off(c, discounts(*[sums[f"{c}_{k}"] for k in (1, 2, 3, 4)])) for c in ("n0", "n1")]
    contexts = pairs.groupBy("left").agg(
        *[F.sum(f"n{t}").alias(f"t{t}") for t in (0, 1)],
        *[F.sum(F.round(offs[t] * 2.0**32).cast("long")).alias(f"o{t}") for t in (0, 1)],  # whole numbers, for any order
    )
    # A context that a class lacks leaves that class's word models whole.
    given = [F.when(F.col(f"t{t}") > 0, F.greatest(F.col(f"o{t}") / 2.0**32 / F.col(f"t{t}"), F.lit(1e-9))).otherwise(1.0) for t in (0, 1)]
    contexts = materialise(contexts.select("left", "t0", "t1", *[g.alias(f"g{t}") for t, g in enumerate(given)]), "toxic-contexts")
    logs = [F.log(F.col(f"g{t}") + F.coalesce((F.col(f"n{t}") - offs[t]) / F.nullif(F.col(f"t{t}"), F.lit(0)), F.lit(0.0)) * F.exp(-F.col(f"log{t}"))) for t in (0, 1)]
    alone = bounded(F.log("g1") - F.log("g0"))

    def rows(mine: Column) -> DataFrame:
        met = pairs.filter(mine).join(words.select(F.col("key").alias("word"), "log0", "log1"), "word").join(contexts.filter(mine), "left")
        met = met.select("left", "word", (bounded(logs[1] - logs[0]) - alone).alias("gain"), (F.col("n0") + F.col("n1")).alias("n"))
        start = F.lit(int(START)).cast("long").alias("word")
        return met.unionByName(contexts.filter(mine).select("left", start, alone.alias("gain"), (F.col("t0") + F.col("t1")).alias("n")))

    def run(batches):
        for batch in batches:
            left, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("left", "word"))
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(left, word).view(np.int64)), batch.column("gain"), batch.column("n")], names=["key", "gain", "n"])

    # A context's bigrams are all in one part, so the parts' shuffles follow one another.
    slices = min(SLICES, 1 + sums["kinds"] // (2 * SLICE))
    parts = []
    for part in range(slices):
        mine = F.pmod(F.xxhash64("left"), F.lit(slices)) == part
        parts.append(materialise(rows(mine).mapInArrow(run, "key long, gain double, n long"), "toxic-bigrams"))
    discard(contexts)
    return parts, 2 * (sums["n0"] + sums["n1"])


def train(labelled: DataFrame) -> Trained:
    """Fit both models and the curve on rows (text, toxic, fold); no row of the held-out fold may be among them.

    The models' texts are written for the counting and go before the bigrams are estimated; the curve's go with the fit.
    """
    models = materialise(labelled.filter(F.col("fold") != CURVE), "toxic-training")
    counts = materialise(class_pairs(models), "toxic-pairs")
    words = materialise(continuations(models, counts), "toxic-counts")
    discard(models)
    gains, unknown, total = estimates(words)
    gains = materialise(gains, "toxic-words")
    discard(words)
    parts, pair_total = higher_order(counts, gains)
    discard(counts)
    pairs = reduce(DataFrame.unionByName, parts)
    heads = head(gains, total, unknown, HEAD), head(pairs, pair_total, 0.0, PAIRS)
    trained = Trained(heads[0], gains, unknown, heads[1], pairs, labelled.sparkSession.sparkContext.broadcast(heads), (0.0, 0.0, 0.0))
    rows = materialise(labelled.filter(F.col("fold") == CURVE), "toxic-training")
    trained = trained._replace(curve=fit_curve(trained, rows))
    discard(rows)
    return trained


def grouped(doc: np.ndarray, key: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets by document, the different keys of each, and how often each occurs there."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[: len(doc)])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=docs))]).astype(np.int32)
    return offsets, key[first].view(np.int64), np.diff(np.append(first, len(doc)))


def dealt(offsets: np.ndarray, keys: np.ndarray, n: np.ndarray) -> list[list[pa.ListArray]]:
    """What ``grouped`` gives as lists by document, of keys and of n, in ``SLICES`` parts by the key."""
    doc, part = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), keys % SLICES
    mine = [part == s for s in range(SLICES)]
    ends = [np.concatenate([[0], np.cumsum(np.bincount(doc[m], minlength=len(offsets) - 1))]).astype(np.int32) for m in mine]
    return [[pa.ListArray.from_arrays(pa.array(e), pa.array(x[m])) for x in (keys, n)] for e, m in zip(ends, mine, strict=True)]


def known(table: Table, pairs: Table, texts: list[str | None]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """By text: sums of the log ratios and of the ratios of the words in ``table``, the sum of what the bigrams and contexts in
    ``pairs`` add, and the number of all words; and the other words, and the other bigrams and contexts, as ``grouped``.

    The different words and bigrams of all the texts are looked up once, in ascending order.
    """
    found = [word_hashes((t or "").encode().lower(), NOT_WORD) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    word, doc = np.concatenate([np.zeros(0, np.uint64), *found]), np.repeat(np.arange(len(found)), sizes)
    values, place = np.unique(word, return_inverse=True)
    lefts, left = np.append(values, START), np.concatenate([[0], place[:-1]])[: len(word)]
    left[(np.cumsum(sizes) - sizes)[sizes > 0]] = len(values)
    bigrams, spot = np.unique(pair_hash(lefts[left], word), return_inverse=True)
    contexts = pair_hash(lefts, START)

    def looked(table: Table, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gain, _, later = table.look(keys)
        return gain[at], later[at]

    gain, later = looked(table, values, place)
    (pair, pair_later), (context, context_later) = looked(pairs, bigrams, spot), looked(pairs, contexts, left)
    parts = (gain, later), (np.exp(np.minimum(gain, MOST)), later)
    sums = [np.bincount(doc, np.where(no, 0.0, v), len(found)) for v, no in parts]
    sums.append(np.bincount(doc, np.where(pair_later, 0.0, pair) + np.where(context_later, 0.0, context), len(found)))
    others = np.concatenate([bigrams[spot[pair_later]], contexts[left[context_later]]])
    rest = [grouped(doc[later], word[later], len(found)), grouped(np.concatenate([doc[pair_later], doc[context_later]]), others, len(found))]
    return [*sums, sizes], rest


def closed(laid: DataFrame, rests: list[tuple], opened: list[str]) -> DataFrame:
    """``laid`` without its open words and bigrams, the columns ``opened``; what these say by the ``rests``' tables is in its sums."""
    held = materialise(laid.withColumn("_id", F.monotonically_increasing_id()), "toxic-open")
    out, written = held.drop(*opened), [held]
    asked = held.agg(*[F.coalesce(F.sum(sum((F.size(f"{key}{s}") for s in range(SLICES)), F.lit(0))), F.lit(0)).alias(key) for *_, key, _ in rests]).first()
    for rest, table, unknown, key, n in rests:
        if rest is None:
            continue
        gain = F.coalesce("gain", F.lit(unknown))
        values = {"_logs": gain, "_ratios": F.exp(F.least(gain, F.lit(MOST)))} if key == "_word" else {"_context": gain}
        # Whole numbers, as their sum does not depend on the order.
        sums = [F.sum(F.round(v * 2.0**32).cast("long") * F.col("n")).alias(f"{c}_more") for c, v in values.items()]

        def later(s: int) -> DataFrame:
            both = F.arrays_zip(F.col(f"{key}{s}").alias("key"), F.col(f"{n}{s}").alias("n"))  # noqa: B023
            return held.select("_id", F.inline(both))

        slices = min(SLICES, 1 + (asked[key] + table.count()) // SLICE)
        parts = []
        for part in range(slices):
            mine = F.pmod(F.pmod(F.col("key"), F.lit(SLICES)), F.lit(slices)) == part
            open_ = reduce(DataFrame.unionByName, [later(s) for s in range(part, SLICES, slices)])
            met = open_.join(table.filter(mine).select("key", "gain"), "key", "left").groupBy("_id").agg(*sums)
            parts.append(materialise(met, "toxic-sums"))
        written += parts
        added = reduce(DataFrame.unionByName, parts).groupBy("_id").agg(*[F.sum(f"{c}_more").alias(f"{c}_more") for c in values])
        out = out.join(added, "_id", "left")
        for c in values:
            out = out.withColumn(c, F.col(c) + F.coalesce(F.col(f"{c}_more") / 2.0**32, F.lit(0.0)))
    out = materialise(out.drop("_id", *[f"{c}_more" for c in ("_logs", "_ratios", "_context")]), "toxic-evidence")
    discard(*written)
    return out


def with_evidence(df: DataFrame, trained: Trained, text_parts: int | None = None) -> DataFrame:
    """All columns of ``df`` but text, and ``evidence``: what the words say, 0 without words and never less.

    A column ``context`` says what the bigrams add per word, 0 without words.

    Most words and bigrams are known from the entries sent to all tasks. Those that may have an entry beyond these
    meet the whole table in a join, where the frequent keys are missing; ``text_parts`` of the texts do so one after another.
    """
    shared = trained.shared
    kept = [f for f in df.schema.fields if f.name not in ("text", "evidence", "context")]
    names, opened = [f.name for f in kept], [f"{c}{s}" for both in (("_word", "_n"), ("_pair", "_m")) for s in range(SLICES) for c in both]
    totals = {"_logs": "double", "_ratios": "double", "_context": "double", "_words": "long"}

    def run(batches):
        for batch in sliced(batches):
            found, rest = known(*shared.value, batch.column("text").to_pylist())
            sums = [pa.array(x) for x in found]
            lists = [x for each in rest for both in dealt(*each) for x in both]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *sums, *lists], names=[*names, *totals, *opened])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{c} {kind}" for c, kind in totals.items()], *[f"{c} array<long>" for c in opened]])
    out = df.select(*names, "text").mapInArrow(run, schema)
    rests = [(trained.head.rest, trained.words, trained.unknown, "_word", "_n"), (trained.pair_head.rest, trained.pairs, 0.0, "_pair", "_m")]
    if any(rest is not None for rest, *_ in rests):
        text_parts = text_parts or TEXT_PARTS
        mine = F.pmod(F.xxhash64("text"), F.lit(text_parts))
        texts = [df.filter(mine == part).select(*names, "text").mapInArrow(run, schema) for part in range(text_parts)]
        out = reduce(DataFrame.unionByName, [closed(part, rests, opened) for part in texts])
    usual = F.greatest(F.lit(-TOPIC), F.least(F.lit(TOPIC), F.col("_logs") / F.col("_words")))
    said = F.greatest(F.log(F.col("_ratios") / F.col("_words")) - usual, F.lit(0.0))
    any_words = F.col("_words") > 0
    return out.select(
        *names, F.when(any_words, said).otherwise(0.0).alias("evidence"), F.when(any_words, F.col("_context") / F.col("_words")).otherwise(0.0).alias("context")
    )


def within(context: Column) -> Column:
    """What bigrams add, as far as the curve goes."""
    return F.greatest(F.lit(-CONTEXT_SPAN), F.least(F.lit(CONTEXT_SPAN), context))


def fit_curve(trained: Trained, rows: DataFrame) -> tuple[float, float, float]:
    """Slopes and offset of the logistic curve, by Newton's method on a histogram of bounded size."""
    cell = F.floor(F.least(F.lit(SPAN), F.col("evidence")) * (CELLS / SPAN))
    side = F.floor(within(F.col("context")) * (CONTEXT_CELLS / CONTEXT_SPAN / 2))
    counts = with_evidence(rows.select("text", "toxic"), trained, 1).groupBy(cell.cast("int").alias("cell"), side.cast("int").alias("side")).agg(
        F.sum("toxic").alias("n1"), F.count("*").alias("n")
    ).orderBy("cell", "side").collect()
    if not counts:
        return 0.0, 0.0, 0.0
    x = np.array([[(r["cell"] + 0.5) * (SPAN / CELLS), (r["side"] + 0.5) * (2 * CONTEXT_SPAN / CONTEXT_CELLS)] for r in counts])
    n, hits = np.array([r["n"] for r in counts], float), np.array([r["n1"] for r in counts], float)
    hits, n = hits + 0.5 / len(n), n + 1.0 / len(n)
    (slope, context, offset), loss = newton(x, n, hits)
    (word_slope, word_offset), word_loss = newton(x[:, :1], n, hits)
    # The bigrams have to make the curve's texts likelier by more than a further parameter does by chance (Schwarz).
    if context < 0 or word_loss - loss < np.log(n.sum()) / 2:
        slope, context, offset = word_slope, 0.0, word_offset
    return float(max(slope, 0.0)), float(context), float(offset)


def newton(x: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of the likeliest logistic curve, and its loss; a row of ``x`` stands for ``n`` texts with ``hits``."""
    design = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([*[1e-4] * x.shape[1], 1e-6])
    beta = np.array([*[0.0] * x.shape[1], np.log(hits.sum() / (n.sum() - hits.sum()))])
    loss = lambda b: (n * np.logaddexp(0, design @ b) - hits * (design @ b)).sum() + b @ ridge @ b / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-(design @ beta)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, design.T @ (hits - n * p) - ridge @ beta)
        scale = 1.0
        while scale > 1e-6 and loss(beta + scale * step) > loss(beta):
            scale /= 2
        beta = beta + scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return beta, float(loss(beta))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, evidence, context and predicted."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    marks = marks.filter(fold(F.col("_id")) != HELD_OUT)
    texts = docs.select("doc_id", "text").filter(fold(F.col("doc_id")) != HELD_OUT)
    # Both sides are dealt by the id at every size: labels grow with the corpus, so they are never sent to all tasks.
    joined = texts.join(marks.hint("merge"), texts.doc_id == F.col("_id"))
    trained = train(joined.select("text", "toxic", fold(F.col("doc_id")).alias("fold")))
    slope, context, offset = trained.curve
    scored = with_evidence(docs.select("doc_id", "text"), trained)
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(context) * within(F.col("context")) + F.lit(offset))))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score.alias("score"), "evidence", "context").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
