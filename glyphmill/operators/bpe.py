"""Byte-level BPE: train on counted pre-tokens, encode, decode.

A word is held as a string with one character per symbol, so that merging a
pair is a ``replace`` and the pairs of a word are its two-character
substrings. Characters rise with token ids, so string order breaks ties the
way id order does.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.draws import listed
from glyphmill.functions.text import stripped_equal
from glyphmill.plans.vocabulary import SPECIAL_TOKENS, VOCAB_SIZE
from glyphmill.session import materialise

# The public byte-level pre-token pattern, and the rule that gives
# every byte a printable letter (printable bytes stand for themselves, the others
# take the letters from U+0100 on). Letters and numbers are tried ahead of the
# contractions, which begin with neither, as most pre-tokens are words.
PRETOKEN_PATTERN = r"(?U) ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHERS = [b for b in range(256) if b not in PRINTABLE]
LETTER = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(OTHERS)}
ALPHABET = sorted(LETTER.values())
MERGED_FROM = 0x144  # first character after the alphabet
SURROGATES = range(0xD800, 0xE000)

HOT = 65_536  # most frequent pairs that a round of training looks at
STRETCHES = 200_000  # different stretches of such pairs that reach the driver in a round
MEMO = 200_000  # encoded pre-tokens remembered per Python task
SLICE = 1 << 21  # letters that a task encodes at once
NEVER = np.iinfo(np.int32).max  # rank of a pair that is not merged
SHORT = 32  # letters of a pre-token that is spelled along with others
TOGETHER = 4096  # pre-tokens that are spelled together


class Tokenizer(NamedTuple):
    """Tokens in id order and merges in rank order; never larger than the vocabulary."""

    tokens: list[str]
    merges: list[tuple[str, str]]


def pretokens(text: Column, cross_lines: bool = False) -> Column:
    """Pre-tokens of a text, line by line as the trainer reads them, or over the whole text."""
    if cross_lines:
        return F.regexp_extract_all(text, F.lit(PRETOKEN_PATTERN), F.lit(0))
    parts = F.split(F.concat(text, F.lit("\n")), r"(?<=\n)")
    return F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(PRETOKEN_PATTERN), F.lit(0))))


def pretoken_counts(df: DataFrame, text: str, cross_lines: bool = False) -> DataFrame:
    """Distinct pre-tokens and how often they occur; counted before the shuffle."""
    pieces = df.select(F.explode(pretokens(F.col(text), cross_lines)).alias("piece"))
    return pieces.where("piece != ''").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def lettered(piece: Column) -> Column:
    """One printable letter per UTF-8 byte."""
    latin = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")
    changed = OTHERS
    return F.translate(latin, "".join(map(chr, changed)), "".join(LETTER[b] for b in changed))


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words as one array, and where each word ends in it."""
    text = "".join(words.to_pylist()).encode("utf-32-le")
    return np.frombuffer(text, np.uint32), np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)


def words_of(letters: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The words of these sizes that the symbols spell, one after the other."""
    text, ends = letters.astype(np.uint32).tobytes().decode("utf-32-le"), np.cumsum(sizes).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def code_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number per pair of symbols, in the order of the pairs."""
    return left.astype(np.int64) << 21 | right.astype(np.int64)


def pair_counts(words: DataFrame) -> DataFrame:
    """(code, n): how often each pair of neighbours occurs. A batch adds its pairs up before it hands them on."""

    def run(batches):
        for batch in batches:
            letters, ends = letters_of(batch.column("word"))
            if len(letters) < 2:
                continue
            inside = np.ones(len(letters) - 1, bool)
            inside[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(letters))] - 1] = False
            places = np.flatnonzero(inside)
            codes = code_of(letters[places], letters[places + 1])
            order = np.argsort(codes)
            codes, n = codes[order], np.asarray(batch.column("n"))[np.searchsorted(ends, places[order], "right")]
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            sums = np.add.reduceat(n, first) if len(first) else n
            yield pa.RecordBatch.from_arrays([pa.array(codes[first]), pa.array(sums)], names=["code", "n"])

    return words.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def stretches(words: DataFrame, hot: list[str]) -> DataFrame:
    """(word, n): the parts of the words between neighbours that are no ``hot`` pair, equal ones added up."""
    codes = np.sort(np.array([ord(p[0]) << 21 | ord(p[1]) for p in hot], np.int64))

    def run(batches):
        for batch in batches:
            letters, ends = letters_of(batch.column("word"))
            if not len(letters):
                continue
            pairs = code_of(letters[:-1], letters[1:])
            at = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
            cut = codes[at] != pairs
            cut[ends[:-1] - 1] = True
            borders = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(letters)]])
            long = np.flatnonzero(np.diff(borders) > 1)
            text = letters.tobytes().decode("utf-32-le")
            n = np.asarray(batch.column("n"))[np.searchsorted(ends, borders[long], "right")]
            found = pa.array([text[borders[i] : borders[i + 1]] for i in long], pa.string())
            yield pa.RecordBatch.from_arrays([found, pa.array(n)], names=["word", "n"])

    return words.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def merged(
    parts: np.ndarray, left: np.ndarray, rank_of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], made: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` symbols each after all their merges, and how many symbols they have then.

    A step merges one pair of each row, the one of lowest rank, leftmost first. ``rank_of(left, right, least)`` gives the
    rank of pairs, ``least`` or more, which is that of the row's last merge; ``made`` the symbol by rank.
    """
    wide = parts.shape[1]
    columns = np.arange(wide)
    out, size = np.zeros_like(parts), np.zeros(len(parts), np.int64)
    rank = np.full(parts.shape, NEVER, np.int32)
    paired = columns[:-1] < left[:, None] - 1
    rank[:, :-1][paired] = rank_of(parts[:, :-1][paired], parts[:, 1:][paired], np.zeros(int(paired.sum()), np.int64))
    rows = np.arange(len(parts))
    while len(rows):
        at = rank.argmin(1)
        best = rank[np.arange(len(rows)), at]
        ended = best == NEVER
        if ended.any():
            out[rows[ended]], size[rows[ended]] = parts[ended], left[ended]
            rows, parts, rank, left, at, best = (x[~ended] for x in (rows, parts, rank, left, at, best))
            if not len(rows):
                break
        each = np.arange(len(rows))
        parts[each, at] = made[best]
        later = np.minimum(columns + (columns > at[:, None]), wide - 1)
        parts, rank = np.take_along_axis(parts, later, 1), np.take_along_axis(rank, later, 1)
        left = left - 1
        for place in (at - 1, at):
            here = (place >= 0) & (place < left - 1)
            rank[each[here], place[here]] = rank_of(parts[each[here], place[here]], parts[each[here], place[here] + 1], best[here])
        gone = at >= left - 1
        rank[each[gone], at[gone]] = NEVER
    return out, size


def advanced(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """The words after these (pair, symbol) merges, one after the other; words of one symbol have no pairs and go."""
    places: dict[str, list[int]] = {}
    for i, (pair, _) in enumerate(merges):
        places.setdefault(pair, []).append(i)
    pairs, many = sorted(places), len(merges) + 1
    codes = np.array([ord(p[0]) << 21 | ord(p[1]) for p in pairs], np.int64)
    # A pair may be merged several times: number of the pair and place of the merge in one.
    turns = np.array([i * many + r for i, pair in enumerate(pairs) for r in places[pair]], np.int64)
    made = np.array([ord(symbol) for _, symbol in merges], np.int32)

    def rank_of(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Place of the next merge of each pair from ``least`` on."""
        asked = code_of(left, right)
        at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
        turn = turns[np.minimum(np.searchsorted(turns, at * many + least), len(turns) - 1)]
        return np.where((codes[at] == asked) & (turn // many == at) & (turn % many >= least), turn % many, NEVER)

    def of(word: str) -> str:
        at = 0
        while True:
            # The next merge, in the order in which they were learnt, of a pair that the word has.
            coming = [r for pair in set(map("".join, zip(word, word[1:]))) for r in places.get(pair, ()) if r >= at]
            if not coming:
                return word
            at = min(coming)
            word = word.replace(*merges[at])
            at += 1

    def run(batches):
        for batch in batches:
            letters, ends = letters_of(batch.column("word"))
            sizes = np.diff(ends, prepend=0)
            n = np.asarray(batch.column("n"))
            long = np.flatnonzero(sizes > SHORT)
            changed, kept = [of(w) for w in batch.column("word").take(pa.array(long)).to_pylist()], [n[long]]
            short = np.flatnonzero(sizes <= SHORT)
            short = short[np.argsort(sizes[short], kind="stable")]
            for some in np.array_split(short, -(-len(short) // TOGETHER)) if len(short) else ():
                left = sizes[some]
                columns = np.arange(int(left.max()))
                here = columns < left[:, None]
                parts = np.zeros(here.shape, np.int32)
                parts[here] = letters[((ends[some] - left)[:, None] + columns)[here]]
                out, size = merged(parts, left, rank_of, made)
                changed += words_of(out[columns < size[:, None]], size)
                kept.append(n[some])
            yield pa.RecordBatch.from_arrays([pa.array(changed, pa.string()), pa.array(np.concatenate(kept))], names=["word", "n"])

    return words.mapInArrow(run, "word string, n long").where(F.length("word") > 1)


class Counted(NamedTuple):
    pair: str
    n: int


class Training:
    """Tokens and merges so far, and the names of the symbols: one character each, rising with the ids."""

    def __init__(self, vocab_size: int, min_frequency: int):
        self.size, self.least = vocab_size, min_frequency
        self.tokens = [*SPECIAL_TOKENS, *ALPHABET]
        self.names = {c: c for c in ALPHABET}
        self.symbols = {c: c for c in ALPHABET}
        self.merges: list[tuple[str, str]] = []
        self.code = MERGED_FROM

    def full(self) -> bool:
        return len(self.tokens) >= self.size

    def learn(self, pair: str) -> tuple[str, bool]:
        """Symbol that the pair becomes, and whether its token is new; a token may be spelled in two ways."""
        left, right = self.names[pair[0]], self.names[pair[1]]
        token, new = left + right, left + right not in self.symbols
        if new:
            self.code = SURROGATES.stop if self.code in SURROGATES else self.code
            self.symbols[token], self.names[chr(self.code)] = chr(self.code), token
            self.tokens.append(token)
            self.code += 1
        self.merges.append((left, right))
        return self.symbols[token], new

    def settle(self, parts: list[tuple[str, int]], cold: int) -> list[tuple[str, str]]:
        """Merge within counted stretches while the best pair is certain; the (pair, symbol) merged.

        Between stretches no pair counts more than ``cold``, and none that merges make there does: its neighbours
        end in the old ones, so it occurs no more often than theirs did. A token that is spelled in a second way
        adds pairs to those its symbol had, so its bound grows by both.
        """
        words, weight = [p for p, _ in parts], [n for _, n in parts]
        count: dict[str, int] = {}
        where: dict[str, set[int]] = {}
        for i, w in enumerate(words):
            for pair in map("".join, zip(w, w[1:])):
                count[pair] = count.get(pair, 0) + weight[i]
                where.setdefault(pair, set()).add(i)
        bound: dict[str, int] = {}
        most = cold
        heap = [(-n, pair) for pair, n in count.items()]
        heapq.heapify(heap)
        done: list[tuple[str, str]] = []
        while heap and not self.full():
            n, pair = heapq.heappop(heap)
            now = count.get(pair, 0)
            if -n != now:
                if now > 0:
                    heapq.heappush(heap, (-now, pair))
                continue
            if now <= most or now < self.least:
                break
            symbol, new = self.learn(pair)
            done.append((pair, symbol))
            ends = max(bound.get(c, cold) for c in pair)
            bound[symbol] = ends if new else bound.get(symbol, cold) + 3 * ends
            most = max(most, bound[symbol])
            grown: set[str] = set()
            for i in where.pop(pair):
                old = words[i]
                made = old.replace(pair, symbol)
                if made == old:
                    continue
                words[i] = made
                for sign, w in ((-1, old), (1, made)):
                    for p in map("".join, zip(w, w[1:])):
                        count[p] = count.get(p, 0) + sign * weight[i]
                        if sign > 0:
                            where.setdefault(p, set()).add(i)
                            grown.add(p)
            for p in grown:
                heapq.heappush(heap, (-count[p], p))
        return done


def train(counts: DataFrame, vocab_size: int = VOCAB_SIZE, min_frequency: int = 2) -> Tokenizer:
    """Learn merges from (piece, n); the same, one by one, as training one merge at a time.

    The words stay in Spark. A round counts all pairs and takes the ``HOT`` most frequent at most. Neighbours
    that are no such pair part a word for good as long as merges count more than they do, so all merges above that
    count are settled on the stretches between them. Equal stretches are added up by a shuffle, and at most
    ``STRETCHES`` different ones reach the driver, whatever the corpus; where there are more, fewer pairs are hot.
    One round settles hundreds to thousands of merges, then brings the words up to date in one narrow pass.
    """
    cores = counts.sparkSession.sparkContext.defaultParallelism
    words = counts.select(lettered(F.col("piece")).alias("word"), "n").where(F.length("word") > 1)
    words = materialise(words.repartition(cores), "words")
    state, wanted = Training(vocab_size, min_frequency), HOT
    while not state.full():
        ranked = pair_counts(words).where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "code").limit(HOT + 1).collect()
        ranked = [Counted(chr(r.code >> 21) + chr(r.code & (1 << 21) - 1), r.n) for r in ranked]
        if not ranked:
            break
        while True:
            # Hot are the pairs that count more than the first one left out.
            cold = ranked[wanted].n if wanted < len(ranked) else min_frequency - 1
            hot = [r.pair for r in ranked if r.n > cold]
            if not hot:
                # One tie longer than the list: its first pair is certain, nothing else.
                done = [(ranked[0].pair, state.learn(ranked[0].pair)[0])]
                break
            parts = materialise(stretches(words, hot), "stretches")
            found = parts.count()
            if found <= STRETCHES or len(hot) == 1:
                done = state.settle([(r.word, r.n) for r in parts.collect()] if found <= STRETCHES else [(hot[0], ranked[0].n)], cold if found <= STRETCHES else ranked[0].n - 1)
                wanted = min(HOT, 2 * wanted)
                break
            wanted = max(1, min(len(hot) // 4, int(len(hot) * STRETCHES / found)))
        if state.full():
            break
        words = materialise(advanced(words, done), "words")
    return Tokenizer(state.tokens, state.merges)


def spell(piece: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Tokens of one pre-token: the pair of lowest rank, leftmost first, is merged
    until none is left. A heap keeps very long pre-tokens cheap."""
    parts = [LETTER[b] for b in piece.encode("utf-8")]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j == n or parts[j] != right:
            continue  # merged away since
        parts[i], parts[j], after[i] = left + right, "", after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (parts[a], parts[b]) in ranks:
                heapq.heappush(heap, (ranks[parts[a], parts[b]], a, (parts[a], parts[b])))
    return [p for p in parts if p]


class Memo:
    """Ids of the pre-tokens met so far in a task; emptied when it has grown large."""

    def __init__(self, model: Tokenizer):
        self.ranks = {m: i for i, m in reversed(list(enumerate(model.merges)))}
        self.number = {t: i for i, t in enumerate(model.tokens)}
        # Own numbers of all strings that come up while a pre-token is spelled.
        names = dict.fromkeys([*LETTER.values(), *chain.from_iterable((a, b, a + b) for a, b in self.ranks)])
        own = {t: i for i, t in enumerate(names)}
        self.ids = np.array([self.number.get(t, -1) for t in own], np.int32)
        self.letter = np.array([own[LETTER[b]] for b in range(256)], np.int32)
        self.kinds = len(own)
        found = sorted((own[a] * self.kinds + own[b], rank, own[a + b]) for (a, b), rank in self.ranks.items())
        self.codes = np.array([f[0] for f in found], np.int64)
        self.rank = np.array([f[1] for f in found], np.int32)
        self.made = np.zeros(len(model.merges), np.int32)
        self.made[self.rank] = [f[2] for f in found]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.widths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NEVER`` if it is not merged."""
        if not len(self.codes):
            return np.full(len(left), NEVER, np.int32)
        code = left.astype(np.int64) * self.kinds + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank[at], NEVER)

    def short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of pre-tokens of about the same length; a step merges one pair of each, as ``spell`` does."""
        left = np.array([len(p) for p in pieces], np.int64)
        columns = np.arange(int(left.max()))
        parts = np.zeros((len(pieces), len(columns)), np.int32)
        parts[columns < left[:, None]] = self.letter[np.frombuffer(b"".join(pieces), np.uint8)]
        out, size = merged(parts, left, lambda a, b, _: self.rank_of(a, b), self.made)
        ids = self.ids[out[columns < size[:, None]]]
        if len(ids) and ids.min() < 0:
            raise KeyError("a token that the vocabulary lacks")
        return ids, size

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pre-tokens not met yet."""
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.array([len(r) for r in raw], np.int64)
        flats, widths, names = [], [], []
        for low, high in ((0, 8), (8, 16), (16, SHORT)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(some, -(-len(some) // TOGETHER)) if len(some) else ():
                ids, size = self.short([raw[i] for i in part])
                flats.append(ids), widths.append(size), names.extend(pieces[i] for i in part)
        for i in np.flatnonzero((sizes > SHORT) | (sizes == 0)):
            ids = [self.number[t] for t in spell(pieces[i], self.ranks)]
            flats.append(np.array(ids, np.int32)), widths.append(np.array([len(ids)], np.int64)), names.append(pieces[i])
        width = np.concatenate(widths)
        first = len(self.flat) + np.cumsum(width) - width
        self.place.update(zip(names, range(len(self.starts), len(self.starts) + len(names))))
        self.starts, self.widths = np.concatenate([self.starts, first]), np.concatenate([self.widths, width])
        self.flat = np.concatenate([self.flat, *flats])

    def encoded(self, pieces: pa.ListArray) -> pa.ListArray:
        """Ids of lists of pre-tokens, the null ones null."""
        if len(self.place) >= MEMO or len(self.flat) >= 20 * MEMO:
            self.forget()
        sizes = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
        coded = pieces.flatten().dictionary_encode()
        asked = coded.dictionary.to_pylist()
        new = [p for p in asked if p not in self.place]
        if new:
            self.learn(new)
        known = np.fromiter((self.place[p] for p in asked), np.int64, len(asked))
        at = known[coded.indices.to_numpy(zero_copy_only=False)] if len(asked) else known
        start, each = self.starts[at], self.widths[at]
        ends = np.cumsum(each)
        values = self.flat[np.repeat(start - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        offsets = pa.array(bounds.astype(np.int32), mask=np.append(pc.is_null(pieces).to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(values))


def sliced(pieces: pa.ListArray) -> Iterator[pa.ListArray]:
    """Rows with about ``SLICE`` letters in all, or one row: what a step needs does not grow with the rows of a batch."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(pieces.flatten()), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = ends[np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False))]
    first = 0
    while first < len(pieces):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield pieces.slice(first, last - first)
        first = last


def encode(text: Column, model: Tokenizer) -> Column:
    """Token ids of a text. One narrow Arrow step without a shuffle: the pre-tokens of a few
    rows at a time become a dictionary in Arrow, and only its entries are looked up or merged."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Memo(model)
        for pieces in batches:
            made = [memo.encoded(some) for some in sliced(pieces)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))

    return ids(pretokens(text, cross_lines=True))


def decode(ids: Column, model: Tokenizer) -> Column:
    """Text of token ids, in the JVM; bytes that are no UTF-8 become U+FFFD, ids beyond the vocabulary are left out."""
    byte_of = {c: b for b, c in LETTER.items()}
    special = set(SPECIAL_TOKENS)
    spelled = [t.encode().hex() if t in special else bytes(byte_of[c] for c in t).hex() for t in model.tokens]
    table = listed(spelled)
    joined = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    return F.make_valid_utf8(F.unhex(joined).cast("string"))


def unknown_ids(ids: Column, model: Tokenizer) -> Column:
    """How many ids the vocabulary does not have."""
    return F.size(F.filter(ids, lambda i: i.isNull() | (i < 0) | (i >= len(model.tokens))))


def roundtrip_check(df: DataFrame, text: str, model: Tokenizer) -> DataFrame:
    """Rows, and rows whose text does not come back."""
    back = df.select(text, encode(F.col(text), model).alias("ids")).withColumn("back", decode(F.col("ids"), model))
    return back.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~stripped_equal(F.col(text), F.col("back"))).alias("failures")
    )


def vocab_table(spark: SparkSession, model: Tokenizer) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(model.tokens)], "token string, id int")


def merge_table(spark: SparkSession, model: Tokenizer) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(model.merges)], "rank int, left string, right string")


def save(spark: SparkSession, model: Tokenizer, path: str) -> None:
    vocab_table(spark, model).write.mode("overwrite").parquet(f"{path}/vocab")
    merge_table(spark, model).write.mode("overwrite").parquet(f"{path}/merges")


def load_public(spark: SparkSession, vocab_json: str, merges_txt: str) -> Tokenizer:
    """Read the two files public tokenizer libraries save; both are bounded by the vocabulary size."""
    ids = json.loads(spark.read.text(vocab_json, wholetext=True).first().value)
    lines = spark.read.text(merges_txt, wholetext=True).first().value.split("\n")
    merges = [tuple(x.split(" ")) for x in lines if x and not x.startswith("#version")]
    return Tokenizer(sorted(ids, key=ids.get), merges)


def load(spark: SparkSession, path: str) -> Tokenizer:
    """Read a saved tokenizer; both tables are bounded by the vocabulary size."""
    tokens = [r.token for r in spark.read.parquet(f"{path}/vocab").orderBy("id").collect()]
    merges = [(r.left, r.right) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    return Tokenizer(tokens, merges)
