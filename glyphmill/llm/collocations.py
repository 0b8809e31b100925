"""Operator 11: phrase collocations by Rabin-Karp fingerprints.

Texts, A-Z in lower case, are cut at ``BREAKS`` into pieces and pieces at blanks and
tabs into words. A phrase is up to three words that stand side by side in a piece;
its frequency counts all its occurrences in the texts of one language.

A task lays its texts out as bytes with one blank between words and sums letters
times powers of a base up; any phrase's fingerprint is then read off two of these
prefix sums. Fingerprints are aggregated in the task, then shuffled with their
number, a pointer to a text that has the phrase (its hash) and the sum of a second,
independent fingerprint. A phrase of n words can only be frequent
if both its parts of n - 1 words are, so after each length a bit filter of the
frequent fingerprints goes to all tasks: ``FILTER_BITS`` bounds its size; where it
fills up it lets more rows through and no frequent one less.

Only what is frequent is looked up in the texts its pointers name. The second
fingerprint of the words found there, times the number of occurrences, has to be
the sum that was counted; where it is not, several phrases share a fingerprint, and
these are counted again with their words as the key.

Null texts are empty, null languages ``und``. Empty tables give no rows. Repeated rows
count each; ties are settled by the order of the result. A text is laid out in blocks
of about ``BLOCK`` bytes that end at a break, so memory does not grow with long texts
unless one piece is longer. Further columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import sliced
from glyphmill.llm.hashing import mix
from glyphmill.session import discard, materialise

LEAST = 10
TOP = 2000
LONGEST = 3
#: Share of a phrase's occurrences, in hundredths, from which a longer candidate around it takes its place.
ABSORBED = 50
BREAKS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
#: Bytes laid out at a time, and occurrences a task holds before it hands them on.
BLOCK = 1_000_000
FLUSH = 1_000_000
#: Bits of a filter for each fingerprint in it, and the most bits of one filter (32 MB).
BITS_EACH, FILTER_BITS = 16, 28
#: Buckets that a language's candidates are ranked in before the last ranking.
BUCKETS = 64

U = np.uint64
IS_BREAK = np.zeros(256, bool)
IS_BREAK[[ord(c) for c in BREAKS]] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[[ord(c) for c in BLANKS]] = True


class Polynomial:
    """Prefix sums of letters times powers of an odd base, modulo 2 to the 64."""

    def __init__(self, base: int, seed: int):
        self.base = base
        self.letters = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
        self.up = self.down = np.ones(1, U)

    def spans(self, raw: np.ndarray, salt: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of raw[start:end], mixed with ``salt``."""
        if len(self.up) <= len(raw):
            size = 1 << len(raw).bit_length()
            powers = [np.full(size, b, U) for b in (self.base, pow(self.base, -1, 2**64))]
            for p in powers:
                p[0] = 1
            self.up, self.down = (np.multiply.accumulate(p) for p in powers)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(self.letters[raw] * self.up[: len(raw)], dtype=U)])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U) + salt)


FIRST = Polynomial(0x9E3779B97F4A7C15, 11)
SECOND = Polynomial(0xD1342543DE82EF95, 12)


def salt_of(lang: str) -> np.uint64:
    return U(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Laid:
    """Some texts as words with one blank between them."""

    def __init__(self, texts: list[tuple[bytes, np.uint64, int]]):
        """``texts``: bytes, salt of the language, hash of the whole text."""
        raw = np.frombuffer(b"\n".join([t[0] for t in texts]).lower() + b"\n", np.uint8)
        gap = IS_GAP[raw]
        edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        kept = ~gap
        kept[ends] = True  # of a gap its first byte, as a blank
        self.raw = np.where(gap, np.uint8(0x20), raw)[kept]
        place = np.cumsum(kept, dtype=np.int32) - 1
        self.starts, self.ends = place[starts], place[ends]
        self.piece = np.cumsum(IS_BREAK[raw], dtype=np.int32)[starts]
        first = np.cumsum([0, *[len(t[0]) + 1 for t in texts]])
        text = np.searchsorted(first, starts, "right") - 1
        self.salt = np.array([t[1] for t in texts], U)[text]
        self.doc = np.array([t[2] for t in texts], np.int64)[text]

    def phrases(self, n: int) -> np.ndarray:
        """First words of the phrases of n words."""
        if len(self.piece) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :])

    def prints(self, i: np.ndarray, n: int, bits: int) -> np.ndarray:
        return shortened(FIRST.spans(self.raw, self.salt[i], self.starts[i], self.ends[i + n - 1]), bits)

    def checks(self, i: np.ndarray, n: int) -> np.ndarray:
        return second(SECOND.spans(self.raw, self.salt[i], self.starts[i], self.ends[i + n - 1]))


def shortened(prints: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits only; fewer than 64 are for tests of collisions."""
    return prints & (~U(0) << U(64 - bits))


def second(values: np.ndarray) -> np.ndarray:
    """31 bits, so that sums of many stay within 63."""
    return (values >> U(33)).astype(np.int64)


def blocks(batches):
    """Lists of (bytes, salt, text hash) of about ``BLOCK`` bytes; long texts are cut behind breaks."""
    for batch in sliced(batches):
        held, size = [], 0
        for text, lang, doc in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "doc")], strict=True):
            rest, salt = (text or "").encode(), salt_of(lang)
            while rest:
                part = rest
                if len(rest) > BLOCK:
                    part = rest[: next((i for i in range(BLOCK, len(rest)) if IS_BREAK[rest[i]]), len(rest) - 1) + 1]
                rest = rest[len(part) :]
                held.append((part, salt, doc))
                size += len(part)
                if size >= BLOCK:
                    yield held
                    held, size = [], 0
        if held:
            yield held


def has(filter_: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the values."""
    if filter_ is None:
        return np.ones(len(values), bool)
    slot = values >> U(64 - 6 - (len(filter_).bit_length() - 1))
    return (filter_[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) == 1


def filter_of(prints: DataFrame) -> np.ndarray:
    """A bit for the leading bits of every fingerprint, as 64-bit words."""
    bits = min(FILTER_BITS, max(12, (BITS_EACH * prints.count()).bit_length()))
    slots = prints.select(F.shiftrightunsigned("fp", 64 - bits).alias("slot"))
    words = slots.groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    written = materialise(words, "filter-words")  # the files it was shuffled by go with that
    rows = written.toArrow()
    discard(written)
    out = np.zeros(1 << (bits - 6), U)
    out[rows.column("word").to_numpy().astype(np.int64)] = rows.column("bits").to_numpy().astype(np.int64).view(U)
    return out


def survivors(laid: Laid, n: int, parts: np.ndarray | None, bits: int) -> np.ndarray:
    """First words of the phrases of n words of which both parts of n - 1 words may be frequent."""
    i = laid.phrases(n)
    if n == 1:
        return i
    every = laid.phrases(n - 1)
    good = np.zeros(len(laid.piece) + 1, bool)
    good[every] = has(parts, laid.prints(every, n - 1, bits))
    return i[good[i] & good[i + 1]]


def counted(docs: DataFrame, n: int, parts: np.ndarray | None, bits: int) -> DataFrame:
    """(fp, n, a, doc, check) of the phrases of n words: occurrences, a pointer, and the sum of second fingerprints."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    names = ["fp", "a", "doc", "check"]

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def out():
            fp, check, doc = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(fp, kind="stable")
            fp, check, doc = fp[order], check[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            columns = [fp[first].view(np.int64), np.diff(np.append(first, len(fp))), doc[first], np.add.reduceat(check, first)]
            for k in range(0, len(first), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], names=names)

        size = 0
        for texts in blocks(batches):
            laid = Laid(texts)
            i = survivors(laid, n, shared.value, bits)
            if len(i):
                held.append((laid.prints(i, n, bits), laid.checks(i, n), laid.doc[i]))
                size += len(i)
            if size > FLUSH:
                yield from out()
                size = 0
        if held:
            yield from out()

    each = docs.select("text", "lang", "doc").mapInArrow(run, "fp long, a long, doc long, check long")
    told = each.groupBy("fp").agg(F.sum("a").alias("a"), F.min("doc").alias("doc"), F.sum("check").alias("check"))
    return told.select("fp", F.lit(n).alias("n"), "a", "doc", "check")


def words_of(text: Column) -> Column:
    """All words of a text in order, without the borders of pieces."""
    return F.array_remove(F.split(text, r"[\x20\x09.,;:!?\x0A-\x0D]+"), "")


def looked_up(docs: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """(fp, n, a, lang, phrase): the words at each pointer, if they account for all occurrences."""
    wanted = frequent.groupBy("doc").agg(F.collect_list(F.struct("fp", "n", "a", "check")).alias("told"))
    wanted = materialise(wanted.withColumnRenamed("doc", "_doc"), "collocation-pointers")
    texts = docs.join(wanted.select("_doc"), docs["doc"] == F.col("_doc"), "left_semi").dropDuplicates(["doc"])
    each = texts.join(wanted, texts["doc"] == F.col("_doc")).select("lang", "text", "doc", "told")

    def run(batches):
        for batch in sliced(batches):
            langs = {salt_of(x): x for x in set(batch.column("lang").to_pylist())}
            told = batch.column("told").flatten()
            fp, n, a, check = (told.field(k).to_numpy() for k in range(4))
            doc = np.repeat(batch.column("doc").to_numpy(), batch.column("told").value_lengths().to_numpy())
            order = np.lexsort((fp, n))
            fp, n, a, check, doc = (x[order] for x in (fp, n, a, check, doc))
            for texts in blocks([batch]):
                laid = Laid(texts)
                whole = laid.raw.tobytes()
                for size in range(1, LONGEST + 1):
                    mine = slice(*np.searchsorted(n, [size, size + 1]))
                    i = laid.phrases(size)
                    if mine.start == mine.stop or not len(i):
                        continue
                    found = laid.prints(i, size, bits).view(np.int64)
                    at = np.minimum(np.searchsorted(fp[mine], found), mine.stop - mine.start - 1) + mine.start
                    hit = (fp[at] == found) & (doc[at] == laid.doc[i])
                    at, first = np.unique(at[hit], return_index=True)
                    i = i[hit][first]
                    good = laid.checks(i, size) * a[at] == check[at]
                    at, i = at[good], i[good]
                    phrases = [whole[p:q].decode() for p, q in zip(laid.starts[i], laid.ends[i + size - 1], strict=True)]
                    columns = [pa.array(fp[at]), pa.array(n[at]), pa.array(a[at]), pa.array([langs[x] for x in laid.salt[i]], pa.string()), pa.array(phrases, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["fp", "n", "a", "lang", "phrase"])

    # A text laid out in several blocks may show a phrase in each.
    return each.mapInArrow(run, "fp long, n int, a long, lang string, phrase string").dropDuplicates(["fp", "n"])


def recounted(docs: DataFrame, shared_prints: DataFrame, bits: int) -> DataFrame:
    """(lang, phrase, n, a) of all phrases with one of these fingerprints (fp, n), counted by their words."""
    wanted = materialise(shared_prints, "collocation-collisions")
    lengths = {r.n: filter_of(wanted.filter(F.col("n") == r.n)) for r in wanted.select("n").distinct().collect()}

    def run(batches):
        for texts in blocks(batches):
            laid = Laid(texts)
            whole = laid.raw.tobytes()
            for n, filter_ in lengths.items():
                i = laid.phrases(n)
                fp = laid.prints(i, n, bits)
                hit = has(filter_, fp)
                i, fp = i[hit], fp[hit]
                phrases = [whole[a:b].decode() for a, b in zip(laid.starts[i], laid.ends[i + n - 1], strict=True)]
                columns = [pa.array(fp.view(np.int64)), pa.array(np.full(len(i), n, np.int32)), pa.array(laid.doc[i]), pa.array(phrases, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "n", "doc", "phrase"])

    each = docs.select("text", "lang", "doc").mapInArrow(run, "fp long, n int, doc long, phrase string")
    told = each.join(wanted, ["fp", "n"], "left_semi").groupBy("doc", "phrase", "n").agg(F.count("*").alias("a"))
    lang = docs.select("doc", "lang").distinct()
    return told.join(lang, "doc").groupBy("lang", "phrase", "n").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n, a) of all phrases of up to ``LONGEST`` words with ``least`` occurrences, and (lang, n) of all words.

    ``docs`` has lang, text and doc, a hash of both.
    """
    found, parts = [], None
    for n in range(1, LONGEST + 1):
        found.append(materialise(counted(docs, n, parts, bits).filter(F.col("a") >= least), f"collocation-prints-{n}"))
        if n < LONGEST:
            parts = filter_of(found[-1])
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    named = materialise(looked_up(docs, every, bits), "collocation-phrases")
    phrases = named.select("lang", "phrase", "n", "a")
    lost = every.select("fp", "n").join(named.select("fp", "n"), ["fp", "n"], "left_anti")
    if lost.limit(1).count():
        phrases = phrases.unionByName(recounted(docs, lost, bits).filter(F.col("a") >= least))
    total = docs.groupBy("lang").agg(F.sum(F.size(words_of(F.col("text"))).cast("long")).alias("total"))
    return materialise(phrases, "collocation-frequent"), total


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, n, a, l, r, score, words) with the cut that scores lowest."""
    cuts = phrases.filter("n > 1").withColumn("w", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")
    cuts = cuts.select("lang", "phrase", "n", "a", cut, "w")
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "n", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        known = phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
        cuts = cuts.join(known, ["lang", side])
    # Products may pass 64 bits.
    score = F.expr("(1000000 * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "n", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = 64) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text; ``bits`` is the length of the fingerprints.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.xxhash64("lang", "text"))
    phrases, total = frequent_phrases(rows, least, bits)
    every = materialise(scored(phrases), "collocation-candidates")
    inner = every.filter("n > 2").withColumn("w", F.split("phrase", " "))
    within = F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("n") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda s: F.array_join(F.slice("w", s, m), " ")),
    ))))
    around = inner.select("lang", within.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = every.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < ABSORBED * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    bucket = F.pmod(F.hash("phrase"), F.lit(BUCKETS)).alias("bucket")
    some = kept.select("lang", "phrase", "a", "l", "r", "score", bucket)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    named = last.join(total.select(F.col("lang").alias("_lang"), F.col("total").alias("n")), F.col("lang") == F.col("_lang"))
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
