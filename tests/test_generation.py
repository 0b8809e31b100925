"""Properties of the generated texts, and draws that do not depend on partitioning."""

import re

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.draws import Draws
from glyphmill.plans import corpus, vocabulary as v
from glyphmill.plans.grammars import TEMPLATES

# First line of each type (fixed values).
FIRST = {
    "flowchart": "flowchart TD", "swimlanes": "flowchart TD", "sequence": "sequenceDiagram", "class_diagram": "classDiagram",
    "state_diagram": "stateDiagram-v2", "er_diagram": "erDiagram", "journey": "journey", "gantt": "gantt", "pie": "pie title ",
    "quadrant": "quadrantChart", "requirement": "requirementDiagram", "gitgraph": "gitGraph", "c4": "C4Context",
    "mindmap": "mindmap", "timeline": "timeline", "sankey": "sankey-beta", "xychart": "xychart-beta", "block": "block-beta",
    "packet": "packet-beta", "kanban": "kanban", "architecture": "architecture-beta", "radar": "radar-beta",
    "eventmodeling": "eventmodeling", "treemap": "treemap-beta", "venn": "venn-beta", "ishikawa": "ishikawa-beta",
    "wardley": "wardley-beta", "cynefin": "cynefin-beta", "treeview": "treeView-beta",
}
LINES = {"flowchart": (8, 24), "swimlanes": (6, 12), "gantt": (6, 9), "pie": (4, 7), "gitgraph": (6, 14), "wardley": (2, 2), "block": (3, 3)}


@pytest.fixture(scope="module")
def texts(spark):
    made = corpus.generate(spark.range(0, 200, 1, 4), "id", 42).collect()
    out = {}
    for r in made:
        out.setdefault(r.diagram_type, []).append(r.target)
    return out


def test_contract(texts):
    assert set(texts) == set(v.DIAGRAM_TYPES) == set(TEMPLATES) and len(TEMPLATES) == 29
    assert len(v.CLASSES) == 30 and v.CLASSES.index(v.NEGATIVE_CLASS) == 14


@pytest.mark.parametrize("name", v.DIAGRAM_TYPES)
def test_shape(texts, name):
    low, high = LINES.get(name, (2, 40))
    for t in texts[name]:
        assert t.split("\n")[0].startswith(FIRST[name])
        assert low <= len(t.split("\n")) <= high
        assert t.count('"') % 2 == 0 and "None" not in t and "null" not in t


def test_flowchart_edges_meet_nodes(texts):
    for t in texts["flowchart"]:
        nodes = re.findall(r"^    (N\d+)[\[\(\{]", t, re.M)
        assert 4 <= len(nodes) <= 9 and nodes == [f"N{i}" for i in range(len(nodes))]
        for a, b in re.findall(r"^    (N\d+) --> ?(?:\|\w+\| )?(N\d+)$", t, re.M):
            assert a in nodes and b in nodes and int(a[1:]) < int(b[1:])
        assert '(["Start"])' in t and '(["End"])' in t


def test_sequence_and_relations_join_different_ends(texts):
    for t in texts["sequence"]:
        for a, b in re.findall(r"^    (\w+)-->?>(\w+): ", t, re.M):
            assert a != b
    for t in texts["class_diagram"]:
        declared = set(re.findall(r"^    class (\w+)$", t, re.M))
        for a, b in re.findall(r"^    (\w+) (?:<\|--|\*--|o--|-->) (\w+)$", t, re.M):
            assert a != b and {a, b} <= declared


def test_running_sums(texts):
    for t in texts["packet"]:
        ranges = [tuple(map(int, x)) for x in re.findall(r"(\d+)-(\d+):", t)]
        assert ranges[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))
    for t in texts["gantt"]:
        days = [(int(a), int(b)) for a, b in re.findall(r"2024-01-(\d\d), (\d)d", t)]
        assert days[0][0] == 1 and all(a[0] + a[1] == b[0] for a, b in zip(days, days[1:]))
    for t in texts["timeline"]:
        years = [int(y) for y in re.findall(r"^    (\d{4}) : ", t, re.M)]
        assert 2018 <= years[0] <= 2023 and all(1 <= b - a <= 2 for a, b in zip(years, years[1:]))


def test_coordinates_stay_below_one(texts):
    seen = [float(x) for t in texts["quadrant"] for x in re.findall(r"0\.\d\d|1\.\d\d", t)]
    assert min(seen) >= 0.02 and max(seen) <= 0.97


def test_templated_types_have_few_texts(spark):
    made = corpus.generate(spark.range(600), "id", 1, v.TEMPLATED_TYPES)
    found = {r.diagram_type: r.n for r in made.groupBy("diagram_type").agg(F.countDistinct("target").alias("n")).collect()}
    assert found == {"gitgraph": 12, "state_diagram": 4, "block": 8, "cynefin": 2, "wardley": 2}


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitioning_changes_nothing(spark, texts, parts):
    got = corpus.generate(spark.range(0, 200, 1, parts), "id", 42, ["pie", "kanban"]).orderBy("id").collect()
    for name in ("pie", "kanban"):
        assert [r.target for r in got if r.diagram_type == name] == texts[name]


def test_draws_are_even(spark):
    d = Draws(7, "s", F.col("id"))
    rows = spark.range(20000).select(d.choice("abcd", "c").alias("c"), F.explode(d.sample(list("abcdef"), F.lit(2), "s")).alias("s"))
    for name, want in (("c", 10000), ("s", 40000 / 6)):
        for r in rows.groupBy(name).count().collect():
            assert abs(r["count"] - want) < want * 0.06
    assert d.sample(list("abc"), F.lit(3), "x") is not None


def test_generation_is_one_narrow_stage(spark):
    plan = corpus.generate(spark.range(10), "id", 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_profiles_of_one_seed_share_their_texts(spark, monkeypatch):
    """Two profiles of one seed have the same texts: each is made once."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(name, row, seed):
        calls.add(1)
        return f"{name} {row} {seed}"

    monkeypatch.setattr(corpus, "TEMPLATES", {"one": None})
    monkeypatch.setattr(corpus, "text_of", lambda name, row, seed, words: text(F.lit(name), row, seed))
    made = corpus.profiles(spark.range(4), "id", 5, {"val": None, "fixed": None, "router": 3})
    got = sorted((r.profile, r.id, r.diagram_type, r.target) for r in made.collect())
    none = corpus.NEGATIVE_CLASS
    want = [(p, i, "one", f"one {i} 6") for p in ("val", "fixed") for i in range(4)]
    want += [("router", i, kind, f"{kind} {i} 5") for i in range(3) for kind in ("one", none)]
    assert got == sorted(want)
    assert calls.value <= 2 * (4 + 3)


def test_profiles_in_their_sizes(spark):
    made = corpus.profiles(spark.range(8), "id", 0, {"router": 3, "val": 2, "corpus": 8})
    got = {(r.profile, r.diagram_type): r["count"] for r in made.groupBy("profile", "diagram_type").count().collect()}
    assert got["router", "not_diagram"] == 3 and ("val", "not_diagram") not in got
    assert got["val", "pie"] == 2 and got["corpus", "pie"] == 8 and len(got) == 30 + 29 + 29
    names = {r.file_name for r in made.where("profile = 'val' AND diagram_type = 'pie'").collect()}
    assert names == {"pie_val_00000.png", "pie_val_00001.png"}


def test_fixed_set_ignores_type_order(spark):
    seeds = spark.createDataFrame([(1234,)], "seed bigint")
    a = {r.diagram_type: r.target for r in corpus.fixed_testset(seeds, "seed").collect()}
    one = corpus.text_of("radar", F.lit(0), F.lit(1234).cast("bigint"))
    assert len(a) == 29 and spark.range(1).select(one.alias("t")).first().t == a["radar"]


def test_skip_and_coverage(spark):
    df = spark.createDataFrame([("a", 'x "l"'), ("a", 'odd "'), ("b", ""), ("b", None), ("c", "fine")], "k string, t string")
    good, bad = corpus.good_and_rejects(df, corpus.well_formed(F.col("t")))
    assert good.count() == 2 and bad.count() == 3
    got = {r.k: (r.ok, r.requested) for r in corpus.coverage(df, "k", ["a", "b", "z"], corpus.well_formed(F.col("t"))).collect()}
    assert got == {"a": (1, 2), "b": (0, 2), "c": (1, 1), "z": (0, 0)}  # a class beyond the requested ones shows too
