"""Operator 13: conversations repaired by the cheapest edits, with a square-root checkpointed dynamic programme.

The rows of a conversation stand in the order of their turn, nulls first, then role
and text. Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty
row of user or assistant 2; a truncated row that stays adds 1, a blank or repeated
one has to go. The roles' initials of what is left match ``(s?(ua)+)?``. Of the
cheapest ways the one whose initials in order come first in ASCII is taken. As the
form fixes the role of every reroled or inserted row, it is one way.

The form is an automaton of four states, so what a run of rows costs is a matrix of
four by four. A conversation of n rows is cut into blocks of about the square root of
n. Blocks give their matrices in parallel; from the last block back these turn into the
vectors of the cost of all that follows, stored at the blocks' borders only. With its
vector every block recomputes its inside and walks forward: first from all four states,
which settles the state at each border, then from the right one, which gives the edits.
So a conversation that holds a third of all rows is spread over the tasks; in one task
there are its borders, its audit and, streamed, the digest of its rows.

A null role or text is one blank. A conversation without a conv_id is one of its own. Empty
texts are blank. Rows that are equal stand side by side, so all but the first
are repeated ones. Long texts are read in the JVM only. Further columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.running import ROWS_PER_BUCKET, with_rank
from glyphmill.session import materialise

#: Rows of a block at least; conversations up to its square have blocks of that size.
BLOCK = 64
SPACE = r"[\x20\x09-\x0D]"
#: Letters of rows: initial (s, u, a, other) times state (sound, truncated, has to go).
KINDS, FIRST_LETTER = "sua", 97
#: States of the form: at its start, behind s, behind u, behind a. Where s, u and a lead, and what is missing at the end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
LEADS = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
WANTED = ("u", "u", "a", "u")
AHEAD = tuple(LEADS[q][WANTED[q]] for q in range(4))
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 50
#: Costs behind the last row: nothing, an answer, or a question and an answer are missing.
AT_END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}


# --- one block -----------------------------------------------------------------------------


def closed(costs: list[int]) -> list[int]:
    """The least costs when rows may be inserted first; two inserts come back to the same state."""
    return [min(costs[q], INSERT + costs[AHEAD[q]], 2 * INSERT + costs[AHEAD[AHEAD[q]]]) for q in range(4)]


def read(letter: str) -> tuple[str, int, bool]:
    """Initial, cost of staying, and whether the row has to go."""
    kind, state = divmod(ord(letter) - FIRST_LETTER, 3)
    return (KINDS + "-")[kind], TRUNCATED * (state == 1), state == 2


def step(letter: str, after: list[int]) -> list[int]:
    """Costs before a row and what may be inserted in front of it, from those behind it."""
    kind, stay, must_go = read(letter)
    costs = [DELETE + after[q] for q in range(4)]
    if not must_go:
        for q in range(4):
            costs[q] = min(costs[q], REROLE + stay + after[AHEAD[q]])
            if kind in LEADS[q]:
                costs[q] = min(costs[q], KEEP + stay + after[LEADS[q][kind]])
    return closed(costs)


@lru_cache(maxsize=50_000)
def matrix(code: str) -> tuple[int, ...]:
    """Cost of a block by the state in front of it and the state behind its last row, row by row."""
    columns = []
    for q in range(4):
        costs = [NEVER] * 4
        costs[q] = 0
        for letter in reversed(code):
            costs = step(letter, costs)
        columns.append(costs)
    return tuple(columns[b][a] for a in range(4) for b in range(4))


@lru_cache(maxsize=50_000)
def walk(code: str, vector: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """Initials of a block's edits from a state on, and the state behind them; the last block inserts what is missing."""
    costs = [list(vector)]
    for letter in reversed(code):
        costs.append(step(letter, costs[-1]))
    costs.reverse()
    out = []
    for i, letter in enumerate(code):
        kind, stay, must_go = read(letter)
        while True:
            now, after = costs[i][state], costs[i + 1]
            if now == DELETE + after[state]:
                out.append("D")
                break
            if now == INSERT + costs[i][AHEAD[state]]:
                out.append("I")
                state = AHEAD[state]
                continue
            if kind in LEADS[state] and not must_go and now == KEEP + stay + after[LEADS[state][kind]]:
                out.append("K")
                state = LEADS[state][kind]
            else:
                out.append("R")
                state = AHEAD[state]
            break
    while last and state in (AFTER_S, AFTER_U):
        out.append("I")
        state = AHEAD[state]
    return "".join(out), state


def illegal_in(code: str) -> int:
    kinds = [read(x)[0] for x in code]
    return sum(a + b not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))


# --- Spark ---------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn`, modulo 20, plants."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    told = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = told.filter("_kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy"))
    return out.drop("_copy")


def conv_key() -> Column:
    """A string that no two conversations share, the one without an id included."""
    return F.to_json(F.struct("conv_id")).alias("conv")


def ranked(rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(conv, turn, role, text, rank) and what the text shows by itself, of rows (conv_id, turn, role, text)."""
    blank = F.lit(" ")
    told = rows.select(conv_key(), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    order = F.coalesce("turn", F.lit(-(2**63))).alias("_order")
    placed = with_rank(told.select("*", order), ["conv"], ["_order", "role", "text"], "rank", rows_per_bucket).drop("_order")
    empty = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    open_ = ~F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    return materialise(placed.withColumns({"empty": empty, "open": open_, "h": F.sha2("text", 256)}), "conversation-rows")


def lettered(placed: DataFrame) -> DataFrame:
    """(conv, turn, rank, letter, blank, duplicate, truncated) of ranked rows; texts stay where they are."""
    slim = placed.select("conv", "turn", "role", "rank", "empty", "open", "h")
    first = slim.groupBy("conv", "role", "h").agg(F.min("rank").alias("rank"))
    # Joined on the rank, so that a text that is said over and over is no hot key.
    marked = slim.drop("h").join(first.select("conv", "rank", F.lit(True).alias("first")), ["conv", "rank"], "left")
    again = ~F.col("empty") & F.col("first").isNull()
    cut = ~F.col("empty") & ~again & F.col("open")
    kind = F.when(F.substring("role", 1, 1).isin(*KINDS), F.instr(F.lit(KINDS), F.substring("role", 1, 1)) - 1).otherwise(len(KINDS))
    state = F.when(F.col("empty") | again, 2).when(cut, 1).otherwise(0)
    letter = F.chr(F.lit(FIRST_LETTER) + 3 * kind + state)
    flags = [c.cast("long").alias(n) for n, c in (("blank", F.col("empty")), ("duplicate", again), ("truncated", cut))]
    return materialise(marked.select("conv", "turn", "rank", letter.alias("letter"), *flags), "conversation-letters")


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows with the number of their block: at least ``block`` rows each, the square root of a longer conversation."""
    long = rows.groupBy("conv").agg(F.count("*").alias("_n")).filter(F.col("_n") > block * block)
    long = materialise(long.select("conv", F.ceil(F.sqrt("_n")).cast("long").alias("_size")), "long-conversations")
    size = F.coalesce("_size", F.lit(block))
    placed = rows.join(long, "conv", "left").withColumn("_size", size)
    return placed.withColumn("block", F.expr("(rank - 1) div _size")).drop("_size")


def mapped(df: DataFrame, columns: list[str], name: str, kind: str, fn) -> DataFrame:
    """Add a column: ``fn`` of the rows' values in ``columns``, Arrow batch by batch."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, {name} {kind}"

    def run(batches):
        for batch in batches:
            values = [fn(*x) for x in zip(*[batch.column(c).to_pylist() for c in columns], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, TYPES[kind])], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


VECTOR = pa.list_(pa.int64())
TYPES = {
    "array<bigint>": VECTOR,
    "array<array<bigint>>": pa.list_(VECTOR),
    "struct<edits:string,state:int>": pa.struct([("edits", pa.string()), ("state", pa.int32())]),
    "bigint": pa.int64(),
}


def backwards(matrices: list[list[int]]) -> list[list[int]]:
    """For each block the costs of all that follows it, by the state behind it; and last the costs in front of the first."""
    out = [list(AT_END)]
    for m in reversed(matrices):
        out.append([min(m[4 * q + b] + out[-1][b] for b in range(4)) for q in range(4)])
    return [*out[-2::-1], out[-1]]


def forwards(ends: list[list[int]]) -> list[int]:
    """The state in front of each block."""
    out = [START]
    for e in ends[:-1]:
        out.append(e[out[-1]])
    return out


def edits(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Per block (conv, block, code, first, start, edits), and per conversation (conv, cost, illegal)."""
    placed = in_blocks(rows.select("conv", "rank", "letter"), block)
    letters = F.sort_array(F.collect_list(F.struct("rank", "letter")))["letter"]
    coded = placed.groupBy("conv", "block").agg(F.array_join(letters, "").alias("code"), F.min("rank").alias("first"))
    coded = mapped(coded, ["code"], "costs", "array<bigint>", lambda c: list(matrix(c)))
    coded = materialise(mapped(coded, ["code"], "illegal", "bigint", illegal_in), "conversation-blocks")
    ends = F.struct("block", "costs", "illegal", F.left("code", F.lit(1)).alias("head"), F.right("code", F.lit(1)).alias("tail"))
    whole = coded.groupBy("conv").agg(F.sort_array(F.collect_list(ends)).alias("b"))
    whole = whole.select("conv", F.col("b.costs").alias("costs"), F.col("b.illegal").alias("inside"), F.col("b.head").alias("heads"), F.col("b.tail").alias("tails"))
    whole = mapped(whole, ["costs"], "vectors", "array<array<bigint>>", backwards)
    borders = lambda heads, tails: sum(illegal_in(a + b) for a, b in zip(tails, heads[1:], strict=False))
    whole = mapped(whole, ["heads", "tails"], "between", "bigint", borders)
    whole = materialise(whole.select("conv", "vectors", "inside", "between"), "conversation-checkpoints")
    illegal = F.aggregate("inside", F.col("between"), lambda a, b: a + b)
    sums = whole.select("conv", F.element_at(F.element_at("vectors", -1), START + 1).alias("cost"), illegal.alias("illegal"))
    at = whole.select("conv", F.size("vectors").alias("_n"), F.posexplode("vectors").alias("_i", "vector"))
    at = at.select("conv", F.col("_i").cast("long").alias("block"), "vector", (F.col("_i") == F.col("_n") - 2).alias("last")).filter("_i < _n - 1")
    known = coded.select("conv", "block", "code", "first").join(at, ["conv", "block"])
    several = known.filter(~F.col("last") | (F.col("block") > 0))
    each = mapped(several, ["code", "vector", "last"], "ends", "array<bigint>", lambda c, v, x: [walk(c, tuple(v), q, x)[1] for q in range(4)])
    starts = each.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "ends"))).alias("b")).select("conv", F.col("b.ends").alias("ends"))
    starts = mapped(starts, ["ends"], "starts", "array<bigint>", forwards).select("conv", F.posexplode("starts").alias("_i", "start"))
    starts = materialise(starts.select("conv", F.col("_i").cast("long").alias("block"), "start"), "conversation-states")
    known = known.join(starts, ["conv", "block"], "left").withColumn("start", F.coalesce("start", F.lit(START).cast("long")))
    done = mapped(known, ["code", "vector", "start", "last"], "done", "struct<edits:string,state:int>", lambda c, v, q, x: dict(zip(("edits", "state"), walk(c, tuple(v), q, x), strict=True)))
    return materialise(done.select("conv", "block", "code", "first", "start", F.col("done.edits").alias("edits")), "conversation-edits"), sums


def acted(blocks: DataFrame) -> DataFrame:
    """(conv, block, pos, edit, rank, role): what each edit does, to or in front of which row, and the role it gives."""
    kind = "array<struct<edit:string,rank:bigint,role:string>>"
    struct = pa.list_(pa.struct([("edit", pa.string()), ("rank", pa.int64()), ("role", pa.string())]))

    def told(code: str, audit: str, state: int, rank: int) -> list[dict]:
        out, place = [], 0
        for e in audit:
            out.append({"edit": e, "rank": rank + place, "role": ROLE[WANTED[state]] if e in "IR" else None})
            if e == "K":
                state = LEADS[state][read(code[place])[0]]
            elif e != "D":
                state = AHEAD[state]
            place += e != "I"
        return out

    def run(batches):
        for batch in batches:
            values = [told(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("code", "edits", "start", "first")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(values, struct)], names=["conv", "block", "done"])

    each = blocks.select("conv", "block", "code", "edits", "start", "first").mapInArrow(run, f"conv string, block long, done {kind}")
    return each.select("conv", "block", F.posexplode("done").alias("pos", "d")).select("conv", "block", "pos", "d.*")


def repaired(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv, block, pos, edit, turn, role, text): the rows that stay or come in, in the order of block and pos."""
    done = acted(blocks).filter("edit != 'D'")
    done = done.select("conv", "block", "pos", "edit", F.col("role").alias("_role"), F.when(F.col("edit") != "I", F.col("rank")).alias("_rank"))
    old = placed.select(F.col("conv").alias("_c"), F.col("rank").alias("_r"), "turn", "role", "text")
    met = done.join(old, (F.col("conv") == F.col("_c")) & (F.col("_rank") == F.col("_r")), "left")
    return met.select("conv", "block", "pos", "edit", "turn", F.coalesce("_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired rows' `role:text`, a newline between.

    Rows and edits are dealt by conversation in one shuffle and stand in its order, each row behind its edits; every
    conversation is streamed through one task, in whatever memory its longest row takes.
    """

    def run(batches):
        conv, digest, rows, edit, new = None, None, 0, None, None
        for batch in batches:
            names, found = [], []
            for c, e, r, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv", "edit", "new", "role", "text")], strict=True):
                if c != conv:
                    if conv is not None:
                        names.append(conv)
                        found.append(digest.hexdigest())
                    conv, digest, rows = c, hashlib.sha256(), 0
                if e is not None and e != "I":
                    edit, new = e, r
                    continue
                if e == "I":
                    line = f"{r}:"
                elif edit == "D":
                    continue
                else:
                    line = f"{new if edit == 'R' else role}:{text}"
                digest.update(("\n" * (rows > 0) + line).encode())
                rows += 1
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], names=["conv", "sha256"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "sha256"])

    none = F.lit(None).cast("string")
    told = acted(blocks).select("conv", "rank", "pos", "edit", F.col("role").alias("new"), none.alias("role"), none.alias("text"))
    rows = placed.select("conv", "rank", F.lit(2**31 - 1).alias("pos"), none.alias("edit"), none.alias("new"), "role", "text")
    dealt = told.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "rank", "pos")
    return dealt.select("conv", "edit", "new", "role", "text").mapInArrow(run, "conv string, sha256 string")


def solved(rows: DataFrame, block: int, rows_per_bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per conversation what was found and done, the ranked rows, and the blocks with their edits."""
    placed = ranked(rows, rows_per_bucket)
    letters = lettered(placed)
    turns = letters.filter("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("_one")).groupBy("conv")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    faults = letters.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    blocks, sums = edits(letters, block)
    audit = F.array_join(F.sort_array(F.collect_list(F.struct("block", "edits")))["edits"], "").alias("audit")
    told = faults.join(gaps, "conv", "left").join(sums, "conv").join(blocks.groupBy("conv").agg(audit), "conv")
    told = told.select("conv", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return told, placed, blocks


def repair(rows: DataFrame, block: int = BLOCK, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) as (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), and their repaired rows."""
    told, placed, blocks = solved(rows, block, rows_per_bucket)
    return told, repaired(placed, blocks)


def audited(rows: DataFrame, block: int = BLOCK, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Damaged and repaired: for every conv_id of ``rows`` its faults, cost, audit and the digest of the repaired rows."""
    told, placed, blocks = solved(damaged(rows), block, rows_per_bucket)
    ids = rows.select("conv_id").distinct().select("conv_id", conv_key())
    out = ids.join(told, "conv", "left").join(digests(placed, blocks), "conv", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
