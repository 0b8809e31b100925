"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from glyphmill.llm import collocations as c

SCHEMA = "lang string, text string, doc_id long"


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    found = defaultdict(list)
    longer = {(lang, p): a for (lang, p), a in f.items() if len(p) == 3 and a >= least}
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        if len(p) == 2 and any(100 * b >= 50 * a for (x, q), b in longer.items() if x == lang and p in (q[:2], q[1:])):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {
        (lang, rank, p.decode(), -a, l, r, n[lang], -score)
        for lang, ps in found.items() for rank, (score, a, p, l, r) in enumerate(sorted(ps)[:top], 1)
    }


def prose(seed, docs=60):
    rng = random.Random(seed)
    words = ["The", "the", "of", "ärger", "été", "a", "b", "c", "sun-set", "#x", "🙂", "Ünd"]
    ends = [" ", "  ", "\t", ", ", ". ", "\n", "\r\n", " ;", "!", "\x0b"]
    out = []
    for i in range(docs):
        text = "".join(rng.choice(words) + rng.choice(ends[:3] if rng.random() < 0.7 else ends) for _ in range(rng.randrange(0, 60)))
        out.append((rng.choice(["en", "de", None, "und"]), text, i))
    return [*out, *out[:5], ("en", None, 900), ("en", "", 901), (None, " . , ", 902), ("fr", "alone", 903)]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in c.collocations(df, **more).collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_count(spark, seed):
    rows = prose(seed)
    assert run(spark, rows, least=3) == brute(rows, 3)


def test_first_of_each_language(spark):
    rows = prose(3)
    assert run(spark, rows, least=2, top=7) == brute(rows, 2, 7)


def test_collisions_are_counted_by_text(spark):
    """With nine bits most phrases share their fingerprint with others."""
    rows = prose(4)
    assert run(spark, rows, least=3, bits=9) == brute(rows, 3)


def test_long_texts_are_cut_at_breaks(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 50)
    rng = random.Random(5)
    text = "".join(rng.choice("abc") + rng.choice([" ", " ", ". "]) for _ in range(400))
    laid = [c.Laid(b) for b in c.blocks([batch(text)])]
    assert len(laid) > 3 and sum(len(part.starts) for part in laid) == len(re.findall("[abc]", text))
    phrases = Counter()
    for part in laid:
        whole, i = part.raw.tobytes().decode(), part.phrases(2)
        phrases.update(whole[a:b] for a, b in zip(part.starts[i], part.ends[i + 1]))
    assert phrases == Counter(m[1] for m in re.finditer(r"(?=(\b[abc] [abc]\b))", text))


def batch(text):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([text]), pa.array(["en"]), pa.array([7])], names=["text", "lang", "doc"])


def test_very_long_text_and_frequent_phrase(spark):
    rows = [("en", "spam egg " * 60_000, 1), ("en", "spam egg.", 2)]
    got = run(spark, rows)
    assert got == brute(rows, 10)
    assert any(r[2] == "spam egg" or "spam egg" in r[2] for r in got)


def test_exact_above_64_bits(spark):
    phrases = spark.createDataFrame(
        [("en", "a", 1, 3 * 10**12), ("en", "b", 1, 7 * 10**12), ("en", "a b", 2, 2 * 10**12 + 1)], "lang string, phrase string, n int, a long"
    )
    assert c.scored(phrases).first().score == 1_000_000 * (2 * 10**12 + 1) ** 2 // (3 * 10**12 * 7 * 10**12)


def test_empty_and_clashing_columns(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("en", "x y. " * 12, i) for i in range(2)]
    df = spark.createDataFrame(rows, "lang string, text string, doc long").selectExpr("*", "1 AS fp", "2 AS n", "3 AS phrase")
    assert {r.phrase for r in c.collocations(df).collect()} == {"x y"}
