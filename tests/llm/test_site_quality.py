"""Site quality: posteriors against plain arithmetic, held-out accuracy, edge cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import site_quality as S
from glyphmill.llm.queries import op5_site_quality


def plain_pull(groups, centre):
    n, within, between = sum(g[0] for g in groups), 0.0, 0.0
    if len(groups) < 2 or n <= len(groups):
        return 1e6
    for (m, s, ss), c in zip(groups, centre, strict=True):
        within += ss - s * s / m
        between += m * (s / m - c) ** 2
    within = max(within, 0.0) / (n - len(groups))
    between = (between - (len(groups) - 1) * within) / max(n - sum(g[0] ** 2 for g in groups) / n, 1e-9)
    return min(1e6, max(1.0, within / between)) if between > 0 else 1e6


def plain_posteriors(rows):
    paths, hosts = defaultdict(lambda: [0, 0.0, 0.0]), defaultdict(lambda: [0, 0.0, 0.0])
    for h, path, p in rows:
        for g in (paths[h, path], hosts[h]):
            g[0], g[1], g[2] = g[0] + 1, g[1] + p, g[2] + p * p
    prior = sum(g[1] for g in hosts.values()) / len(rows)
    weight = plain_pull(list(hosts.values()), [prior] * len(hosts))
    host = {h: (g[1] + weight * prior) / (g[0] + weight) for h, g in hosts.items()}
    weight = plain_pull(list(paths.values()), [hosts[h][1] / hosts[h][0] for h, _ in paths])
    return {k: (host[k[0]], (g[1] + weight * host[k[0]]) / (g[0] + weight)) for k, g in paths.items()}


def test_posteriors(spark):
    rnd = random.Random(2)
    rows = []
    for h in [None, *range(12)]:
        level = rnd.random()
        for path in (None, "a", "b"):
            inside = min(0.99, max(0.01, level + rnd.uniform(-0.2, 0.2)))
            rows += [(None if h is None else f"h{h}", path, min(0.99, max(0.01, rnd.gauss(inside, 0.1)))) for _ in range(rnd.randint(1, 30))]
    got, prior = S.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    want = plain_posteriors(rows)
    assert abs(prior - sum(r[2] for r in rows) / len(rows)) < 1e-9
    assert {(r.host, r.path): (r.host_posterior, r.path_posterior) for r in got.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def corpus(n):
    rnd = random.Random(4)
    words, docs, labels = [f"w{i}" for i in range(400)], [], []
    for i in range(n):
        good = rnd.random() < (0.9 if i % 5 else 0.2)
        text = " ".join(rnd.choice(words) + ("" if good else rnd.choice(["##", "%%", ""])) for _ in range(rnd.randint(15, 80)))
        docs.append((i, text, f"h{i % 5}", f"p{i % 2}"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(1200)
    odd = [(None, None, None, None), (5000, "", None, "p0"), (5001, "x" * 200_000, "h1", None), (7, docs[7][1], "h2", "p1")]
    table = spark.createDataFrame([(*d, "e") for d in docs + odd], "doc_id long, text string, host string, path string, evidence string")
    rows = S.quality(table, spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    truth = {i: q for i, q, _ in labels}
    assert len(rows) == len(docs) + len(odd)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.kept == bool(truth[r.doc_id]) for r in held) > 0.97 * len(held)
    hosts = {r.host: r.host_posterior for r in rows}
    assert hosts["h0"] < 0.5 < hosts["h1"]


def test_without_labels(spark):
    docs, _ = corpus(20)
    table = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert S.quality(table, none).filter(F.col("evidence") != 0).count() == 0
    assert S.quality(table.limit(0), none).count() == 0


def test_query(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op5_site_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    assert sum(good) > 0.97 * len(good)
