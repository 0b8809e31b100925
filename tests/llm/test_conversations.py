"""Conversation repair against all ways of editing, and against plain damage."""

import hashlib
import random
import re
from binascii import crc32
from functools import lru_cache

import pytest

from glyphmill.llm import conversations as c

FORM = re.compile("(s?(ua)+)?")


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def judged(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) over all edits, roles tried one by one and the form checked by its pattern."""

    def fits(form):  # whether something that matches begins with it
        return any(FORM.fullmatch(form + end) for end in ("", "a", "ua"))

    def state(form):
        return (bool(form), form[-1:])

    @lru_cache(None)
    def best(i, tail, inserts):
        form = {(False, ""): "", (True, "s"): "s", (True, "u"): "u", (True, "a"): "ua"}[tail]
        found = []
        if i == len(rows):
            if FORM.fullmatch(form):
                found.append((0, "", ()))
        else:
            role, text = rows[i][2:]
            options = [(3, "D", None)]
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                options.append((late, "K", (role, text)))
                options += [(2 + late, "R", (r, text)) for r in ("user", "assistant")]
            for cost, letter, row in options:
                grown = form if row is None else form + row[0][:1]
                if row is None or (row[0] and fits(grown)):
                    rest = best(i + 1, state(grown), 0)
                    if rest:
                        found.append((cost + rest[0], letter + rest[1], (row, *rest[2]) if row else rest[2]))
        if inserts < 3:
            for r in ("user", "assistant"):
                if fits(form + r[0]):
                    rest = best(i, state(form + r[0]), inserts + 1)
                    if rest:
                        found.append((2 + rest[0], "I" + rest[1], ((r, ""), *rest[2])))
        return min(found, default=None)

    return best(0, state(""), 0)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = hurt([r for r in rows if r[0] == conv])
        faults = judged(mine)
        cost, audit, kept = cheapest(tuple(mine), tuple(faults))
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def talk(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for conv in [*range(convs), None]:
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ua"])
            text = rng.choice(["Yes.", "No!", "Why? \n", "cut off", " ", "", None, "ça va.", "Yes.", "x "])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None, -turn]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, **more):
    got = c.audited(spark.createDataFrame(rows, SCHEMA), **more).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("block", [64, 2])
def test_equals_all_ways_of_editing(spark, block):
    """With blocks of two rows nearly every conversation has checkpoints."""
    rows = talk(1, 60, 9)
    assert run(spark, rows, block=block) == brute(rows)


def test_many_more(spark):
    rows = talk(2, 400, 7)
    assert run(spark, rows, block=1) == brute(rows)


def test_longer_than_a_block_and_ranked_in_buckets(spark):
    rows = [(1, t, *(("user", "Why?") if t % 3 else ("assistant", f"So {t}."))) for t in range(300)] + [(2, 0, "user", "Hi.")]
    want = brute(rows)
    assert run(spark, rows, block=4) == want
    assert run(spark, rows, rows_per_bucket=40) == want


def test_blocks_give_what_the_whole_gives():
    rng = random.Random(3)
    for _ in range(200):
        code = "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 40)))
        size = rng.randrange(1, 9)
        parts = [code[k : k + size] for k in range(0, len(code), size)]
        vectors = c.backwards([list(c.matrix(p)) for p in parts])
        assert vectors[-1] == c.backwards([list(c.matrix(code))])[-1]
        state, audit = c.START, ""
        for k, p in enumerate(parts):
            done, state = c.walk(p, tuple(vectors[k]), state, k == len(parts) - 1)
            audit += done
        assert audit == c.walk(code, c.AT_END, c.START, True)[0]


def test_repaired_rows_match_the_form(spark):
    df = spark.createDataFrame(talk(4, 40, 9), SCHEMA)
    told, kept = c.repair(df)
    forms = {}
    for r in sorted(kept.collect(), key=lambda r: (r.conv, r.block, r.pos)):
        forms[r.conv] = forms.get(r.conv, "") + r.role[0]
    assert all(FORM.fullmatch(f) for f in forms.values())
    assert {r.conv: len(r.audit) - r.audit.count("D") for r in told.collect() if len(r.audit) > r.audit.count("D")} == {k: len(v) for k, v in forms.items()}


def test_long_texts_extra_columns_and_empty_table(spark):
    rows = [(7, 0, "user", "word " * 100_000 + "?"), (7, 1, "assistant", "." * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "2 AS block", "3 AS conv")
    assert {r.conv_id: tuple(r)[1:] for r in c.audited(df).collect()} == brute(rows)
    assert c.audited(spark.createDataFrame([], SCHEMA)).count() == 0
