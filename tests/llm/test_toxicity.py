"""Toxicity: counts against brute force, held-out accuracy, edge cases."""

import os
import random
import zlib
from collections import Counter

import numpy as np

from glyphmill.llm import toxicity as X
from glyphmill.llm.hashing import NOT_WORD, shingle_set, word_hashes
from glyphmill.llm.queries import op7_toxicity
from glyphmill.session import work_dir


def corpus(n, seed=3):
    rnd = random.Random(seed)
    plain, nasty = [f"word{i}" for i in range(300)], [f"vile{i}" for i in range(12)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 120))]
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rnd.randrange(len(words))] = rnd.choice(nasty)
        docs.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(3000)
    docs += [(9000, None, None), (9001, "", "x"), (None, "vile1 vile2 vile3", None), (9002, "vile1 vile2 vile3 word1", "x"), (9002, "word1 word2", "x")]
    table, marks = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    rows = X.toxicity(table, marks).collect()
    truth = {i: t for i, _, t in labels}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 600 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = [r for r in rows if r.doc_id == 9002]
    assert sorted(r.predicted for r in by_id) == [0, 1]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(400)
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    one, two = (
        {r.doc_id: r.score for r in X.toxicity(table, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped)
    )
    assert one == two


def test_without_labels(spark):
    table = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in X.toxicity(table, marks).collect()] == [0.5]
    assert X.toxicity(table.limit(0), marks).count() == 0


def test_counts(spark):
    docs, labels = corpus(60)
    rows = [(t, lab[2], 0) for (_, t, _), lab in zip(docs, labels, strict=True)]
    got = X.counted(spark.createDataFrame(rows, "text string, toxic int, fold int"), lambda w: w).collect()
    want = Counter()
    for t, y, _ in rows:
        want.update((int(h), y) for h in word_hashes(t.encode(), NOT_WORD).view(np.int64))
    assert {(r.key, y): r[f"n{y}"] for r in got for y in (0, 1) if r[f"n{y}"]} == dict(want)


def mixed(n=400, seed=5):
    """Rows (text, toxic, fold) of words of very different frequency, so that all counts of counts occur."""
    rnd = random.Random(seed)
    zipf = lambda top: f"w{int(top ** rnd.random())}"
    return [(" ".join(zipf(3000 if i % 4 else 900) for _ in range(rnd.randint(0, 50))), int(i % 4 == 0), i % 3) for i in range(n)]


def brute(rows):
    """Both models in plain Python: log ratio of a word, and evidence of a text."""
    n, pairs = [Counter(), Counter()], set()
    for text, toxic, _ in rows:
        w = text.split()
        n[toxic].update(w)
        pairs |= set(zip(["<s>", *w[:-1]], w))
    lefts = Counter(w for _, w in pairs)
    kinds = len(lefts)
    logs = []
    for c in (0, 1):
        many = [0, *[sum(v == k for v in n[c].values()) for k in (1, 2, 3, 4)]]
        y = many[1] / (many[1] + 2 * many[2])
        d = [0, *[k - (k + 1) * y * many[k + 1] / many[k] for k in (1, 2, 3)]]
        total = sum(n[c].values())
        back = sum(d[min(v, 3)] for v in n[c].values()) / total
        logs.append(lambda w, n=n[c], d=d, total=total, back=back: np.log((n[w] - d[min(n[w], 3)]) / total + back * (lefts[w] + X.UNSEEN) / (len(pairs) + X.UNSEEN * (kinds + 1))))

    def evidence(text):
        x = np.array([logs[1](w) - logs[0](w) for w in (text or "").split()])
        return max(0.0, np.log(np.exp(np.minimum(x, X.MOST)).mean()) - np.clip(x.mean(), -X.TOPIC, X.TOPIC)) if len(x) else 0.0

    return evidence


def test_scores_equal_plain_models(spark, monkeypatch):
    """Whatever the tasks hold: all words, the most frequent 300 at most, or one."""
    rows = mixed()
    want = brute([r for r in rows if r[2] != X.CURVE])
    texts = [None, "", "w1", "unseen", "w1 w2 unseen w2 w2500", *[r[0] for r in rows[:80]], "w3 " * 20_000]
    asked = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(t, y, 0) for t, y, _ in rows], "text string, toxic int, fold int")
    for size in (1 << 22, 300, 1):
        monkeypatch.setattr(X, "HEAD", size)
        got = {r.id: r.evidence for r in X.with_evidence(asked, X.train(table)).collect()}
        assert all(abs(got[i] - want(t)) < 1e-6 for i, t in enumerate(texts))


def brute_context(rows):
    """What the bigrams of both classes add to the words of a text, in plain Python."""
    n, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for text, toxic, _ in rows:
        w = text.split()
        n[toxic].update(w)
        pairs[toxic].update(zip(["<s>", *w[:-1]], w))
    every = set(pairs[0]) | set(pairs[1])
    lefts = Counter(w for _, w in every)

    def off(counts):
        many = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        d = X.discounts(*many)
        return lambda k: d[min(k, 3) - 1] if k else 0.0

    def model(c):
        words, two, total = off(n[c]), off(pairs[c]), sum(n[c].values())
        back = sum(map(words, n[c].values())) / total
        seen, given = Counter(), Counter()
        for (v, _), k in pairs[c].items():
            seen[v] += k
            given[v] += two(k)

        def added(v, w):
            alone = (n[c][w] - words(n[c][w])) / total + back * (lefts[w] + X.UNSEEN) / (len(every) + X.UNSEEN * (len(lefts) + 1))
            if not seen[v]:
                return 0.0, 0.0
            share = given[v] / seen[v]
            return np.log((pairs[c][v, w] - two(pairs[c][v, w])) / seen[v] / alone + share), np.log(share)

        return added

    models = [model(0), model(1)]

    def context(text):
        w = (text or "").split()
        met = [[m(v, x) for m in models] for v, x in zip(["<s>", *w[:-1]], w)]
        seen = [(v, x) in every for v, x in zip(["<s>", *w[:-1]], w)]
        return np.mean([np.clip(b[not s] - a[not s], -X.MOST, X.MOST) for (a, b), s in zip(met, seen, strict=True)]) if w else 0.0

    return context


def test_bigrams_equal_plain_models(spark, monkeypatch):
    """The order of bigrams above the words, whatever the tasks hold of it."""
    rows = mixed()
    want = brute_context([r for r in rows if r[2] != X.CURVE])
    texts = [None, "", "w1", "unseen", "w1 w2 unseen w2 w2500", *[r[0] for r in rows[:80]], "w3 " * 2000]
    asked = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(t, y, 0) for t, y, _ in rows], "text string, toxic int, fold int")
    assert max(abs(want(t)) for t in texts) > 0.1
    for size in (1 << 20, 300, 1):
        monkeypatch.setattr(X, "PAIRS", size)
        monkeypatch.setattr(X, "SLICE", 100 if size == 300 else 1 << 20)
        got = {r.id: r.context for r in X.with_evidence(asked, X.train(table)).collect()}
        assert all(abs(got[i] - want(t)) < 1e-6 for i, t in enumerate(texts))


def test_order_of_words_tells_classes_apart(spark):
    """Both classes have the same words equally often; only their order differs."""
    rnd = random.Random(8)
    phrase = lambda toxic: " ".join(f"l{k} r{k if toxic else (k + 1) % 6}" for k in rnd.choices(range(6), k=3))
    docs = [(i, " ".join(rnd.choice([f"w{rnd.randrange(40)}", phrase(i % 2)]) for _ in range(20))) for i in range(900)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    rows = X.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), marks).filter("held_out").collect()
    assert np.mean([(r.score > 0.5) == r.doc_id % 2 for r in rows]) > 0.9


def test_work_tables_go(spark, monkeypatch):
    """Texts, counts, open words and sums are off the disks when the scores are there, in parts of the texts or not."""
    docs, labels = corpus(300)
    table = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(1, None), (2, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(X, "HEAD", 5)
    monkeypatch.setattr(X, "PAIRS", 300)
    got = []
    for parts in (1, 3):
        monkeypatch.setattr(X, "TEXT_PARTS", parts)
        before = set(os.listdir(work_dir(spark)))
        rows = X.toxicity(table, marks)
        left = {name.rsplit("-", 1)[0] for name in set(os.listdir(work_dir(spark))) - before}
        assert left <= {"toxic-words", "toxic-bigrams", "toxic-evidence"}
        got.append(sorted(map(str, rows.collect())))
    assert got[0] == got[1] and len(got[0]) == len(docs) + 2


def test_shared_order_counts_contexts(spark):
    texts = [(f"word{i} spread", 1) for i in range(40)] + [("fixed phrase", 1)] * 40 + [(f"word{i} plain", 0) for i in range(80)]
    got = sorted((r.n0, r.n1, r.lefts) for r in X.continuations(spark.createDataFrame(texts, "text string, toxic int")).collect() if r.lefts > 1 or r.n0 + r.n1 > 2)
    assert got == [(0, 40, 1)] * 2 + [(0, 40, 40), (80, 0, 80)]


def test_discounts():
    assert X.discounts(0, 3, 1, 1) == (0.5, 0.75, 1.0)
    d = X.discounts(400, 120, 60, 40)
    assert 0 < d[0] < 1 < d[1] < 2 and d[2] < 3


def test_held_out_quality_on_the_given_table(spark):
    """Held-out rows of sf0.1: most toxic ones are found and few others; the area under the curve is high."""
    sf = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic in (0, 1)")
    rows = op7_toxicity(spark, sf).join(marks, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    toxic, plain = ([r for r in rows if r.toxic == y] for y in (1, 0))
    assert sum(r.predicted for r in toxic) > 0.8 * len(toxic) and sum(r.predicted for r in plain) < 0.05 * len(plain)
    order = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in plain)
    assert order > 0.9 * len(toxic) * len(plain)


def test_word_hashes():
    words = "the cat the x éé x1 The".split()
    h = word_hashes(" the cat\tthe x éé\n\nx1  The ".encode())
    assert len(h) == 7 and h[0] == h[2] and len(set(h.tolist())) == 6 == len(set(words))
    assert len(word_hashes(b"")) == 0 and len(word_hashes(b" \n")) == 0
    alone = [word_hashes(w.encode())[0] for w in words]
    assert alone == h.tolist()
    assert len(shingle_set(b"a b c")) == 1 and len(shingle_set(b"a b c d e f")) == 2 and len(shingle_set(b" ")) == 0


def test_query(spark, sf):
    rows = op7_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
