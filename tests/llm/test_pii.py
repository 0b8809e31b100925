"""Personal data: base spans against plain patterns, the field against enumeration, edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import pii as P
from glyphmill.llm.queries import op9_personal_data
from glyphmill.llm.secrets import told


def plain(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(n) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(n[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def rand_text(rnd):
    some = ["a@b.co", "x.y@", "@", "10.0.0.1", "300.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (269) 555-3296", "+49", "12", "é٣", "word", ".", "\n", "0001.002.03.4", "+12.34.56.78.90"]
    return "".join(rnd.choice(some) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(0, 9)))


def test_base_spans():
    rnd = random.Random(8)
    for _ in range(3000):
        text = rand_text(rnd)
        assert P.base_spans(text) == plain(text), text


def segmentations(n, segments):
    """All sets of segments that do not overlap."""
    for k in range(n + 1):
        for some in itertools.combinations(range(len(segments)), k):
            if all(segments[a][1] <= segments[b][0] or segments[b][1] <= segments[a][0] for a, b in itertools.combinations(some, 2)):
                yield some


def test_best_segmentation_against_enumeration():
    rnd = np.random.default_rng(5)
    for text in ("a@b.co 10.0.0.1", "+1 269 555 3296 x", "1234567 89", "12.3.4.5.6"):
        part = P.lattice(text, 0, len(text))
        names = sorted({f for s in part.segments for f in s[2]})
        weights = P.Weights({"": 0} | {f: k + 1 for k, f in enumerate(names)}, np.hstack([np.zeros((len(names) + 1, 1)), rnd.normal(0, 1, (len(names) + 1, P.TYPES - 1))]))
        top = [max(P.scores(weights, s[2])[1:]) for s in part.segments]
        want = max(sum(top[k] for k in some) for some in segmentations(3, part.segments))
        found = P.best(part, weights)
        score = sum(P.scores(weights, f)[kind] for i, j, kind in found for a, b, f in part.segments if (a, b) == (i, j))
        assert len(found) <= 3 and score >= want - 1e-9


def test_field_learns_and_adds():
    rnd = random.Random(1)
    texts = []
    for _ in range(300):
        number = lambda k: "".join(str(rnd.randrange(10)) for _ in range(k))
        texts.append(f" +1 ({number(3)}) 555-{number(4)} ")
        card = number(15)
        texts.append(" " + next(card + str(d) for d in range(10) if P.luhn(card + str(d))) + " ")
        texts.append(f" {rnd.choice(['jo', 'al.b', 'x9'])}@mail{rnd.randrange(9)}.example.com ")
        texts.append(f" {'.'.join(str(rnd.randrange(256)) for _ in range(4))} ")
    weights = P.fit(P.samples_of(texts + P.decoys(200)))
    joined = texts[0].strip() + texts[1].rstrip()
    assert P.base_spans(joined) == []
    assert [s[0] for s in P.all_spans(joined, weights)] == ["card", "phone"]
    assert P.all_spans("Version 2.0 of 12.12.2020, page 17 of 2000000 1 1 1 1", weights) == []


def test_edges(spark):
    rows = [(None, "a@b.co"), (1, None), (2, ""), (3, "10.0.0.1 " * 3000), (3, "10.0.0.1 " * 3000), (4, "1 " * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = P.personal(docs, P.train(docs)).select("doc_id", F.size(F.filter("spans", lambda s: s["base"])).alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 3000), (3, 3000), (4, 0)]
    assert P.personal(docs.limit(0), P.train(docs.limit(0))).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_personal_data(spark, sf).collect():
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in P.KINDS)
        told_base = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told_base.encode()).hexdigest()
        assert set(told_base.split(",")) <= set(r.spans.split(","))
    assert told is not None


def test_long_runs_of_zeros():
    assert P.base_spans("1.2.3." + "0" * 5000) and not P.base_spans("1.2.3." + "9" * 5000)
