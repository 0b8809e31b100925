"""Decontamination against a search of every place, planted edits, edge cases."""

import random

from glyphmill.llm import decontaminate as D
from glyphmill.llm.queries import op4_decontaminate


def fewest(window, text):
    """Edits of the best occurrence of the window anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        new = [i + 1]
        for j in range(1, len(text) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (text[j - 1] != c)))
        row = new
    return min(row)


def held(docs, items):
    """(doc, item) pairs by trying every window at every place."""
    out = set()
    for d, text in docs:
        text = D.fold(text or "")[0]
        for i, item in items:
            item = D.fold(item or "")[0]
            starts = {*range(0, max(1, len(item) - D.WIDTH + 1), D.STRIDE), max(0, len(item) - D.WIDTH)}
            cut = [item[s : s + D.WIDTH] for s in starts if len(item) >= D.LEAST]
            if any(w in text or fewest(w, text) <= D.budget(len(w)) for w in cut):
                out.add((d, i))
    return out


def noisy(rnd, text, edits):
    text = list(text)
    for _ in range(edits):
        p = rnd.randrange(len(text))
        text[p : p + 1] = rnd.choice([[], [text[p], "q"], ["é"]])
    return "".join(text)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    items = [(i, sentence(rnd.randint(5, 45))) for i in range(8)] + [(8, None), (9, "short"), (10, "")]
    items.append((11, items[0][1]))
    docs = [(None, None), (1, ""), (2, items[3][1].upper().replace(" ", "\n \t"))]
    for d in range(3, 60):
        _, source = items[rnd.randrange(8)]
        part = source[rnd.randint(0, 20) :] if rnd.random() < 0.4 else source
        docs.append((d, f"{sentence(rnd.randint(0, 12))} {noisy(rnd, part, rnd.randint(0, 14))} {sentence(rnd.randint(0, 12))}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    got = D.leaks(table, bench).collect()
    want = held(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and 20 < len(want)
    kept = D.clean(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted({d or 0 for d, _ in docs} - {d for d, _ in want})


def test_place_of_an_exact_copy(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away from it"
    text = f"Önce  {item.replace(' ', '   ')}. End"
    got = D.leaks(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(1, 7, 0)] * 2
    assert " ".join(text[got[0].start : got[0].end].split()) == item


def test_blocks_and_empty_tables(spark, monkeypatch):
    words = [f"w{i}x{i * i}" for i in range(400)]
    items = [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in items] + [(99, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK", 7)
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == {(i, i) for i in range(20)}
    assert D.leaks(docs, bench.limit(0)).count() == 0
    assert D.clean(docs.limit(0), bench).count() == 0


def test_insertion_at_every_diagonal_offset():
    rnd = random.Random(1)
    item = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100))
    copy = list(item)
    for p in (12, 30, 65, 83):
        copy[p] = "ß"
    copy.insert(50, "é")
    block = D.index([(7, item)])
    for offset in range(2 * D.budget(D.WIDTH) + 1):
        assert D.found_in("0" * offset + "".join(copy), block) == [(0, offset, offset + 101, 5)]


def test_query(spark, sf):
    docs = {r.doc_id: D.fold(r.text)[0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: D.fold(r.text)[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in op4_decontaminate(spark, sf).collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert whole <= set(got)
    assert all(got[p].edits == 0 for p in whole)
