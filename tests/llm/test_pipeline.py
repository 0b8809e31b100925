"""The pipeline, stage by stage against plain versions over all pairs and places."""

import importlib.util
from collections import Counter
from pathlib import Path

import pytest
import sentencepiece

import corpus_pipeline
from glyphmill.llm import decontaminate as D
from glyphmill.llm.queries import tokenizer_model

HERE = Path(__file__).parent


def load(name):
    spec = importlib.util.spec_from_file_location(name, HERE / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def plain_leaks(docs, items):
    """Documents that hold a window of an item as it is; the tables plant no edited passages."""
    cut = []
    for text in items:
        text = D.fold(text or "")[0]
        starts = {*range(0, max(1, len(text) - D.WIDTH + 1), D.STRIDE), max(0, len(text) - D.WIDTH)}
        cut += [text[s : s + D.WIDTH] for s in starts if len(text) >= D.LEAST]
    return {d for d, t in docs for f in [D.fold(t or "")[0]] if any(w in f for w in cut)}


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of each stage, as rows."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_and_types(spark, sf, stages):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.dtypes == given.dtypes, name
        assert after.filter("n_chars != length(text)").count() == 0


def test_quality(spark, sf, stages):
    before, after = stages["quality_rules"]
    brute = load("test_quality_rules").brute
    failed = {d for d, t in texts(before) if brute(t)[-1]}
    kept = {d for d, _ in texts(after)}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not failed & kept
    good = [d for d, _ in texts(before) if labels.get(d) == 1 and d not in failed]
    assert sum(d in kept for d in good) > 0.97 * len(good)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    rows = sorted(texts(before))
    assert dict(texts(after)) == load("test_near_documents").brute_lines(rows)


def test_near_copies(stages):
    before, after = stages["ngram_join"]
    found = load("test_near_documents").brute_components(texts(before))
    assert sorted(d for d, _ in texts(after)) == sorted(d for d, n, c in found if n == 0 or d == c)


def test_benchmark(spark, sf, stages):
    before, after = stages["decontaminate"]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept, held = {d for d, _ in texts(after)}, plain_leaks(texts(before), items)
    assert kept == {d for d, _ in texts(before)} - held


def test_tokens(stages):
    before, after = stages["sentencepiece"]
    library, given = sentencepiece.SentencePieceProcessor(model_file=tokenizer_model()), dict(texts(before))
    rows = after.collect()
    assert len(rows) == len(given)
    for r in rows:
        ids = library.encode(given[r.doc_id], add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids))


def test_run_chains_the_stages(spark, sf, stages):
    want = Counter((r.doc_id, tuple(r.ids)) for r in stages["sentencepiece"][1].collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_empty_and_odd_rows(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a " * 30, "en", "s", 60), (2, "a " * 30, "en", "s", 60)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
