"""Linked documents and repeated lines against comparing all pairs, with crowds made of small bounds."""

import random
import re

import pytest

from glyphmill.llm import lines as L
from glyphmill.llm import near_documents as N
from glyphmill.llm.common import components
from glyphmill.llm.queries import op3_ngram_join, op6_line_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, lower):
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORDS.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def brute_components(docs):
    sets = [(d, shingles(t, True)) for d, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    seen = set()
    for ids in index.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    if find(i) != find(j) and alike(sets[i][1], sets[j][1]):
                        root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(s), (least.get(find(i)) if s else d) or 0) for i, (d, s) in enumerate(sets))


def changed(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return words


def family(rnd, size, copies, most):
    seed = [f"w{rnd.randrange(5000)}" for _ in range(size)]
    return [" ".join(changed(rnd, seed, rnd.randint(0, most))) for _ in range(copies)]


def corpus(rnd):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \n", "One two", "one TWO", "one two three", "a b c d e", "É f", "é f"]
    for size, copies, most in ((30, 12, 2), (120, 25, 8), (450, 14, 20), (60, 6, 1)):
        texts += family(rnd, size, copies, most)
    texts += [f"{' '.join(f'u{rnd.randrange(10**6)}' for _ in range(rnd.randint(5, 90)))} {passage}" for _ in range(40)]
    texts += [" ".join(f"v{rnd.randrange(40)}" for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    texts += [texts[20]] * 5
    return texts


@pytest.mark.parametrize("frequent", [2, 6, 50])
def test_components_against_all_pairs(spark, frequent):
    docs = list(enumerate(corpus(random.Random(frequent))))
    docs += [(None, docs[30][1]), (None, "quite alone here in this text"), docs[40], docs[40]]
    table = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, n int")
    got = N.linked(table, frequent).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id or 0) for r in got) == brute_components(docs)


def test_one_of_each(spark):
    docs = [(5, "a b c d e f"), (3, "A b c d e f"), (9, "other words"), (10, None), (11, "")]
    out = N.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == [3, 9, 10, 11]
    assert N.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_lines(docs):
    rows = [(i, d, k, x, shingles(x, False)) for i, (d, t) in enumerate(docs) if t is not None for k, x in enumerate(t.split("\n"))]
    gone = set()
    for a in range(len(rows)):
        if any(alike(rows[a][4], rows[b][4]) for b in range(a)):
            gone.add((rows[a][0], rows[a][2]))
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, (d, t) in enumerate(docs)}


@pytest.mark.parametrize("frequent", [2, 50])
def test_lines_against_all_pairs(spark, frequent):
    rnd = random.Random(frequent)
    pool = [x for x in corpus(rnd) if x is not None] + ["", "tab\tand  blanks", "tab and blanks", "\x0b"]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 6)))) for i in range(60)] + [(60, None), (61, "")]
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, line string")
    out = L.dedup(table, "n_removed", frequent)
    assert out.columns == ["doc_id", "text", "line", "n_removed"]
    got, want = {r.doc_id: r for r in out.collect()}, brute_lines(docs)
    assert {d: r.text for d, r in got.items()} == want


def test_lines_edges(spark):
    rows = [(None, "same line here"), (1, "same line here\nmore"), (2, "long " * 40_000), (3, "more"), (3, "more"), (4, "")]
    out = L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "n_removed").collect()
    assert sorted(((r.doc_id or 0), r.text[:20], r.n_removed) for r in out) == [
        (0, "same line here", 0), (1, "more", 1), (2, ("long " * 4)[:20], 0), (3, "", 1), (3, "", 1), (4, "", 0)]
    assert L.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60, 1)] + [(100, 101), (103, 101), (200, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[103] == 100 and got[500] == 200


def test_queries(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op3_ngram_join(spark, sf).collect())
    assert got == brute_components(docs)
    assert op6_line_dedup(spark, sf).count() == len(docs)


def test_lines_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two\nthree"), (2, "one two")], "doc_id long, text string")
    names = ["_gone", "_hash", "_id", "_copy", "row", "cut", "gone", "copy", "a.b"]
    out = L.dedup(docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names]), "n_removed")
    assert out.columns == ["doc_id", "text", *names, "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[2][n] for n in names] == [f"{n}2" for n in names] and got[2].text == "" and got[1].text == "one two\nthree"


def test_windows_meet_every_pair_once(spark):
    from glyphmill.llm import setjoin as S

    lists = [(k, n, 5, 5) for k, size in ((1, 2), (2, 9), (3, 150), (4, 1)) for n in range(size)]
    places = S.placed(spark.createDataFrame([*lists, lists[0]], "key long, node long, n int, v int"))
    left = places.filter("node % 3 = 0")
    met, most = [], 0
    for low, high in S.windows(places):
        some = S.met_within(left, places, low, high).select("key", "node", "node_y").collect()
        met += map(tuple, some)
        most = max(most, high)
    want = [(k, n, m) for k, size in ((1, 2), (2, 9), (3, 150)) for n in range(0, size, 3) for m in range(size) if m != n]
    assert sorted(met) == sorted(want) and most >= 150
