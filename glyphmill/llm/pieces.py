"""Operator 8: SentencePiece BPE encoding and decoding by a prefix table.

The last token of the encoding of every prefix of a text is unique, and it
depends on the text before it through one token only: token ``t`` ends the
prefix of length ``i`` when it is the whole prefix, or when the last token ``u``
of the prefix before ``t`` is compatible with it, which means that merging the
letters of ``u`` and ``t`` gives back ``u`` and ``t``. So the table of last tokens
is filled from left to right: an automaton names all pieces that end at a place,
and the pair test picks the one that fits. The ids are then read backwards.

No piece of the vocabulary has a word mark behind another character, so a text
is cut in front of each run of marks, and a segment between two characters that stand side by
side in no piece either; what is left is encoded and decoded alone.
Arrow gives the different segments of a batch, so each is looked at once there, and
a bounded memo per Python worker keeps those seen.

Null texts count as empty. An empty text has the end id only. Very long texts are encoded in
batches of their own, in memory in proportion to their length. Repeated rows,
ties and extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import sliced

MARK = "▁"
#: Segments that one worker remembers; the memo starts afresh when it is full.
MEMO = 300_000
LONG = 200
PAIRS = 400_000
#: Runs of letters, and runs of anything else.
RUNS = re.compile(r"[^\W\d_]+|[\W\d_]+").findall


def settings(model: bytes) -> dict[int, dict[int, int]]:
    """The numeric fields of the model's trainer (2) and normaliser (3) messages."""

    def number(b: bytes, i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return value, i

    def fields(b: bytes):
        i = 0
        while i < len(b):
            key, i = number(b, i)
            if key & 7 == 0:
                value, i = number(b, i)
            else:
                size, i = number(b, i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
                value, i = b[i : i + size], i + size
            yield key >> 3, value

    out: dict[int, dict[int, int]] = {2: {}, 3: {}}
    for field, value in fields(model):
        if field in out:
            out[field] = {k: v if isinstance(v, int) else len(v) for k, v in fields(value)}
    return out


class Pieces:
    """The vocabulary of one model file, its automaton and pair tests."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        told = settings(model.serialized_model_proto())
        if told[2].get(3) != 2 or told[3].get(2, 0) or told[3].get(4, 1) or not told[3].get(3, 1) or told[2].get(24, 0):
            raise ValueError("only merge-type models with the identity normaliser and a leading word mark are supported")
        count = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(count)]
        self.unk, self.end = model.unk_id(), model.eos_id()
        self.bytes = {int(names[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
        special = {i for i in range(count) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        self.ids = {names[i]: i for i in range(count) if i not in special}
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece has a word mark behind another character")
        # A merge comes earlier the higher its score; equal scores are taken from the left.
        order = sorted({model.get_score(i) for i in self.ids.values()}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        self.rank = {x: place[model.get_score(i)] for x, i in self.ids.items()}
        self.right: dict[str, list] = {}
        self.left: dict[str, list] = {}
        self.automaton = ahocorasick.Automaton()
        for x in self.ids:
            tree = self.tree(x)
            if tree is not None:
                self.right[x], self.left[x] = self.spine(tree, 1), self.spine(tree, 0)
                self.automaton.add_word(x, self.ids[x])
        self.automaton.make_automaton()
        self.surface = [x.replace(MARK, " ") for x in names]
        for i in special:
            self.surface[i] = ""
        self.surface[self.unk] = " ⁇ "
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.last_byte = max(self.byte_of, default=-1)
        self.pairs = {a + b for x in self.ids for a, b in zip(x, x[1:])}
        self.names, self.count, self.length = names, count, [len(x) for x in names]
        #: Whether letters stand beside other characters in no piece, apart from marks.
        self.apart = all(len(RUNS(x.lstrip(MARK))) <= 1 for x in self.ids)
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, tuple[bytes, str]] = {}
        self.parts: dict[str, tuple[bytes, str]] = {}

    def tree(self, piece: str):
        """How the merges build ``piece``: (text, birth, left, right), or None if they end elsewhere."""
        parts = [(c, -1, None, None) for c in piece]
        while len(parts) > 1:
            best = min(
                ((self.rank[a[0] + b[0]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a[0] + b[0] in self.rank),
                default=None,
            )
            if best is None:
                return None
            rank, i = best
            a, b = parts[i], parts[i + 1]
            parts[i : i + 2] = [(a[0] + b[0], max(rank, a[1], b[1]), a, b)]
        return parts[0]

    @staticmethod
    def spine(tree, side: int) -> list[tuple[str, float, float]]:
        """The parts along one edge of a tree, with the ranks at which each appears and is merged away."""
        out, gone = [], float("inf")
        while tree is not None:
            out.append((tree[0], tree[1], gone))
            gone, tree = tree[1], tree[2 + side]
        return out

    def compatible(self, u: int, t: int) -> bool:
        """No merge crosses the border of pieces ``u`` and ``t`` while its two parts stand beside each other."""
        known = not any(
            (rank := self.rank.get(a + b)) is not None and (at := max(rank, born_a, born_b)) < gone_a and at <= gone_b
            for a, born_a, gone_a in self.right[self.names[u]]
            for b, born_b, gone_b in self.left[self.names[t]]
        )
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[u * self.count + t] = known
        return known

    def segment(self, text: str) -> list[int]:
        """The ids of one segment."""
        n = len(text)
        last = [-1] * (n + 1)
        filled, fits, length, count = 0, self.fits, self.length, self.count
        for end, piece in self.automaton.iter(text):
            # Places where no piece ends hold a character outside the vocabulary: nothing merges across it.
            while filled < end:
                filled += 1
            if filled > end:
                continue
            before = last[end + 1 - length[piece]]
            if before >= 0:
                fit = fits.get(before * count + piece)
                if fit is None:
                    fit = self.compatible(before, piece)
                if not fit:
                    continue
            filled = end + 1
            last[filled] = piece
        out: list[int] = []
        at = n
        while at:
            piece = last[at]
            if piece < 0:
                found = [self.bytes.get(b, self.unk) for b in text[at - 1].encode()]
                out.extend(reversed(found if self.bytes else [self.unk]))
                at -= 1
            else:
                out.append(piece)
                at -= length[piece]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of the text, without an end id."""
        if not text:
            return b""
        parts = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return b"".join([self.known(p[1:])[0] if p[1:2] != MARK else array("i", self.segment(p)).tobytes() for p in parts])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: marks become blanks, the leading one goes, byte runs are read as UTF-8."""
        text = self.joined(ids)
        return text[1:] if text[:1] == " " and self.starts_marked(ids) else text

    def joined(self, ids: list[int]) -> str:
        surface = self.surface
        if self.byte_of and ids and min(ids) <= self.last_byte:
            out: list[str] = []
            run = bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(lenient(bytes(run)))
                    run.clear()
                out.append(surface[i])
            if run:
                out.append(lenient(bytes(run)))
            return "".join(out)
        return "".join([surface[i] for i in ids])

    def one(self, run: str) -> tuple[bytes, str]:
        """Packed ids of a run of characters, and the text that they decode to."""
        found = self.memo.get(run)
        if found is None:
            ids = self.segment(run)
            found = array("i", ids).tobytes(), self.joined(ids)
            if len(run) <= LONG:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[run] = found
        return found

    def known(self, part: str) -> tuple[bytes, str]:
        """The same of a part between blanks, which a mark stands before."""
        if part.isascii() and part.isalpha():
            return self.one(MARK + part)
        found = self.parts.get(part)
        if found is None:
            found = self.joint(MARK + part)
            if len(part) <= LONG:
                if len(self.parts) >= MEMO:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def joint(self, part: str) -> tuple[bytes, str]:
        """No token crosses the border of two characters that stand side by side in no piece."""
        pairs = self.pairs
        if self.apart and part[1:].isascii():
            runs = RUNS(part[1:]) or [""]
            runs[0] = MARK + runs[0]
            met = [self.one(r) for r in runs]
            return b"".join([ids for ids, _ in met]), "".join([text for _, text in met])
        cuts = [k for k, (a, b) in enumerate(zip(part, part[1:]), 1) if a + b not in pairs]
        if not cuts:
            return self.one(part)
        met = [self.one(part[a:b]) for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]
        return b"".join([ids for ids, _ in met]), "".join([text for _, text in met])

    def batch(self, texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
        """Ids with an end id, and decoded texts.

        Texts are cut at blanks in Arrow; only the different parts of the batch are encoded and decoded. Texts with
        marks of their own or with blanks side by side or at an end are taken one by one.
        """
        texts = pc.fill_null(texts, "").cast(pa.string())
        odd = pc.or_(pc.match_substring_regex(texts, f"{MARK}|  |^ | $"), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        met = [self.known(p) for p in coded.dictionary.to_pylist()]
        alone = np.flatnonzero(odd)
        ones = [self.encode(t) for t in texts.take(pa.array(alone)).to_pylist()]
        # One list of runs of ids: the parts, the texts that stand alone, the end id.
        runs = [ids for ids, _ in met] + ones + [np.array([self.end], np.int32).tobytes()]
        flat = np.frombuffer(b"".join(runs), np.int32)
        width = np.array([len(r) // 4 for r in runs], np.int32)
        start = np.cumsum(width, dtype=np.int32) - width
        place = coded.indices.to_numpy(zero_copy_only=False)
        sizes = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(alone):
            place = place[np.repeat(~odd, sizes)]
            place = np.insert(place, np.cumsum(np.where(odd, 0, sizes))[alone], len(met) + np.arange(len(alone)))
            sizes[alone] = 1
        place = np.insert(place, np.cumsum(sizes), len(runs) - 1)
        each = width[place]
        ends = np.cumsum(each, dtype=np.int32)
        values = flat[np.repeat(start[place] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        offsets = np.append(np.zeros(1, np.int32), ends[np.cumsum(sizes + 1) - 1])
        spelled = pa.array([t for _, t in met], pa.string()).take(coded.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(parts.offsets, spelled), "")
        back = pc.utf8_slice_codeunits(joined, 1)  # the first part's mark
        if len(alone):
            some = pa.array([self.decode(np.frombuffer(o, np.int32).tolist()) for o in ones], pa.string())
            back = pc.replace_with_mask(back, pa.array(odd), some)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), back

    def starts_marked(self, ids: list[int]) -> bool:
        first = next((i for i in ids if self.surface[i] or i in self.byte_of), None)
        return first is not None and first not in self.byte_of and self.surface[first][:1] == " " and first != self.unk


def lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for every byte that is not part of a whole character."""
    out, i = [], 0
    while i < len(raw):
        size = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 1
        try:
            out.append(raw[i : i + size].decode())
            i += size
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_decode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``ids`` (array<int>, an end id last) and ``decoded`` (string) to every row of ``df``.

    ``model`` is a path that every worker can open. Columns of ``df`` that have
    one of the two new names are replaced.
    """
    kept = df.drop(ids, decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def run(batches):
        known = pieces(model)
        for batch in sliced(batches, text):
            lists, back = known.batch(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, back], names=schema.fieldNames())

    return kept.mapInArrow(run, schema)


def ids_text(ids: Column) -> Column:
    """The ids in decimal, one blank between them."""
    return F.concat_ws(" ", ids.cast("array<string>"))
