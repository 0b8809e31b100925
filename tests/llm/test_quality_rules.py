"""Quality rules: measures against brute force, the estimate on votes of known accuracy, edge cases."""

import random
import re
from math import log

from glyphmill.llm.quality_rules import RULES, VOTES, WINDOW, estimate, fit, judged, odds, with_measures, with_votes
from glyphmill.llm.queries import op10_quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = {}, set()
    for i in range(len(w) - WINDOW + 1):
        seen.setdefault(tuple(w[i : i + WINDOW]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(WINDOW)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def measured(spark, texts):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    return with_measures(docs)


def test_measures(spark):
    rnd = random.Random(5)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e a b c d e", "a " * 5, "a " * 6, "x" * 100_000, "é😀 # |\n\nq\nq", "a\xa0b c"]
    texts += ["".join(rnd.choice("ab#\n  \tÉ") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += [" ".join(rnd.choice("pq") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in judged(measured(spark, texts), estimate([])).collect():
        assert (*[r[c] for c in names], r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_estimate_tells_good_from_bad():
    rnd = random.Random(9)
    rates = [((0.8, 0.19, 0.01), (0.4, 0.2, 0.4)), ((0.6, 0.38, 0.02), (0.1, 0.3, 0.6))] * (len(RULES) // 2)
    counted, truth = {}, {}
    for _ in range(40_000):
        y = rnd.random() < 0.8
        votes = tuple(rnd.choices(VOTES, r[0 if y else 1])[0] for r in rates)
        counted[votes] = counted.get(votes, 0) + 1
        truth.setdefault(votes, []).append(y)
    model = estimate(list(counted.items()))
    assert abs(model.good - 0.8) < 0.02
    for found, given in zip(model.rates, rates, strict=True):
        assert all(abs(a - b) < 0.03 for f, g in zip(found, given, strict=True) for a, b in zip(f, g, strict=True))
    right = sum(y == (odds(model, v) > 0) for v, ys in truth.items() for y in ys)
    assert right > 0.99 * 40_000


def test_empty_table_and_all_abstain(spark):
    empty = with_votes(measured(spark, []))
    model = fit(empty)
    assert model == estimate([]) and judged(empty, model).count() == 0
    silent = sum(log(good[1] / bad[1]) for good, bad in model.rates)
    assert abs(odds(model, (0,) * len(RULES)) - log(model.good / (1 - model.good)) - silent) < 1e-9


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in rows if quality.get(r.doc_id) == 0) < 0.1 * sum(quality.get(r.doc_id) == 0 for r in rows)
    good = [r.kept for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) > 0.97 * len(good)
    assert any(not r.base_failed and not r.kept for r in rows)


def test_verdict_decides_behind_the_base_test(spark):
    """On the larger table: junk that passes the base test goes by the posterior, good documents stay."""
    sf = "/root/testdata/sf0.01"
    rows = op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    junk, good = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert junk and sum(junk) < 0.1 * len(junk) and sum(good) > 0.97 * len(good)


def test_constant_rules_say_nothing():
    votes = [((1,) * len(RULES), 900), ((1, 1, -1, -1, *(1,) * (len(RULES) - 4)), 100)]
    model = estimate(votes)
    assert all(good == bad for j, (good, bad) in enumerate(model.rates) if j not in (2, 3))
    assert odds(model, votes[0][0]) > 0 > odds(model, votes[1][0])
