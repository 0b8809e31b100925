"""Secrets against a brute-force scan, and the edge cases of the docstring."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm.queries import op2_secrets
from glyphmill.llm.secrets import KINDS, REACH, secrets, told

PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def brute(text):
    """(start, place, end, kind, role, strong) of all parts that are reported."""
    text, found = text or "", []
    for place, (kind, (role, strong, pattern, group, least)) in enumerate(KINDS.items()):
        for m in re.finditer(PATTERNS.get(kind, pattern), text, re.A):
            if len(m.group(group)) >= least:
                found.append((m.start(), place, m.end(), kind, role, strong))
    near = lambda a, b: b[0] <= a[2] + REACH and a[0] <= b[2] + REACH
    return sorted(a for a in found if a[5] or any(a[4] != b[4] and near(a, b) for b in found))


def digest(items):
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in items)


def rand_text(rnd):
    some = ["password", "Token = 'abc123", "secret:", "token: token: abcdef", "api_key=x", "APIKEY='longer-value9'", "AKIA" + "Z9" * 8, "AKIAX",
            "0123456789abcdef01234567", "deadbeef" * 5, "user=bob", "https://h.example.com/a", "Ab1+" * 10, "é" * 30, " " * 250, "\n", "😀", "=", "'"]
    return "".join(rnd.choice(some) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 14)))


def test_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [rand_text(rnd) for _ in range(400)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r.doc_id: r.s for r in secrets(docs).select("doc_id", told(F.col("spans")).alias("s")).collect()}
    assert got == {i: digest(brute(t)) for i, t in enumerate(texts)}


def test_edges(spark):
    hot = "secret=abcdef " * 3000
    rows = [(None, "token=abcdef1"), (1, None), (2, ""), (3, "password=hunter22"), (3, "password=hunter22"), (4, hot)]
    got = secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("spans").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 3000)]
    assert secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weak_parts_need_company(spark):
    far = " " * (REACH + 10)
    rows = [(0, "user=bob alone"), (1, f"user=bob{far}token=abcdef12"), (2, "user=bob token=abcdef12 at https://h.example.com/x")]
    out = secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", told(F.col("spans")).alias("s"))
    kinds = {r.doc_id: re.findall("[a-z]+[0-9]*(?=:[0-9]+:)", r.s) for r in out.collect()}
    assert kinds == {0: [], 1: ["assign"], 2: ["login", "assign", "address"]}


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_query(spark, folder):
    sf = f"/root/testdata/{folder}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        all_spans = brute(texts[r.doc_id])
        base = [s for s in all_spans if s[5]]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in base) for k in ("assign", "access", "hex"))
        assert r.spans == digest(all_spans)
        assert r.base_sha256 == hashlib.sha256(digest(base).encode()).hexdigest()
