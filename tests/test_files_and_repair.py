"""Files as other tools write them, label repair against plain Python, scalar helpers."""

import json
import re
import struct
import zlib
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import text, vectors
from glyphmill.operators import classify, metrics, repair, sequences as seq
from glyphmill.session import work_dir
from glyphmill.sources import files


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + b"\0" * width * 3 for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_sidecar_pairs(spark, tmp_path):
    good = {"diagram_type": "pie", "worker_id": 3, "target": "pie title X", "written_at": 1.5}
    for stem, image, note in [
        ("w00_slot_01", png(60, 40), json.dumps(good, indent=2)), ("w00_slot_02", png(60, 40)[:-20], json.dumps(good)),
        ("w01_slot_01", png(60, 40), None), ("w01_slot_02", png(60, 40), '{"diagram_type": "pi'), ("w02_slot_00", b"no image", "{}"),
    ]:
        (tmp_path / f"{stem}.png").write_bytes(image)
        if note is not None:
            (tmp_path / f"{stem}.json").write_text(note)
    got = {r.stem: r for r in files.read_sidecar_pairs(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "w00_slot_01": "ok", "w00_slot_02": "corrupt", "w01_slot_01": "missing_meta", "w01_slot_02": "missing_meta", "w02_slot_00": "corrupt",
    }
    assert (got["w00_slot_01"].width, got["w00_slot_01"].height, got["w00_slot_01"].meta.worker_id) == (60, 40, 3)
    assert got["w02_slot_00"].width is None


def test_labelled_tree(spark, tmp_path):
    for split, label, n in (("train", "pie", 3), ("val", "pie", 1), ("train", "not_diagram", 2)):
        folder = tmp_path / split / label
        folder.mkdir(parents=True)
        for i in range(n):
            (folder / f"{label}_{i:05d}.png").write_bytes(png(5, 5))
    tree = files.read_labelled_tree(spark, str(tmp_path), "*.png")
    got = {(r.split, r.label): r["count"] for r in tree.groupBy("split", "label").count().collect()}
    assert got == {("train", "pie"): 3, ("val", "pie"): 1, ("train", "not_diagram"): 2}
    assert {r.stem for r in tree.where("label = 'not_diagram'").collect()} == {"not_diagram_00000", "not_diagram_00001"}
    ids = {r.label: r.label_id for r in classify.label_index(tree.select("label"), "label").collect()}
    assert ids == {"not_diagram": 0, "pie": 1}


def test_manifest_of_one_file_and_pruned_folders(spark, tmp_path):
    rows = [{"file_name": f"{i}.png", "diagram_type": "pie", "target": "a\nb", "theme": "neo", "look": "neo", "split": s} for i, s in enumerate(["val", "train", "train"])]
    (tmp_path / "manifest.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert files.read_manifest(spark, str(tmp_path / "manifest.jsonl"), "train").count() == 2
    files.write_manifest(files.read_manifest(spark, str(tmp_path / "manifest.jsonl")), str(tmp_path / "out"))
    back = files.read_manifest(spark, str(tmp_path / "out"), "val")
    assert [r.asDict() for r in back.collect()] == rows[:1]
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().executedPlan().toString()
    corpus = files.read_corpus(spark, str(tmp_path / "manifest.jsonl"))
    assert "ReadSchema: struct<target:string>" in corpus._jdf.queryExecution().executedPlan().toString()


def test_history_and_predictions_as_one_json_array(spark, tmp_path):
    (tmp_path / "history.json").write_text(json.dumps([{"epoch": i, "train_loss": 1.0 / i, "val_acc": 0.5} for i in (1, 2, 3)], indent=2))
    assert files.read_history(spark, str(tmp_path / "history.json"), whole_file=True).count() == 3
    (tmp_path / "p.json").write_text(json.dumps([{"diagram_type": "pie", "ground_truth": "a", "prediction": " a\n", "exact_match": True}], indent=2))
    got = files.read_predictions(spark, str(tmp_path / "p.json"), whole_file=True)
    assert metrics.exact_match(got.drop("exact_match")).first().exact_match


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("pie", "a\nb", "a\nb", True), ("c4", "x", "y", False)], "diagram_type string, ground_truth string, prediction string, exact_match boolean")
    files.write_eval_report(df, str(tmp_path / "r"), ["diagram_type"])
    assert files.read_lines(spark, str(tmp_path / "r" / "header")).first().value == "Round-trip test: 1/2 exact matches"
    blocks = "\n".join(r.value for r in files.read_lines(spark, str(tmp_path / "r" / "blocks")).collect())
    assert blocks.startswith("=== c4  (exact_match=False) ===\n--- ground truth ---\nx\n--- prediction ---\ny\n")
    assert spark.read.json(str(tmp_path / "r" / "rows")).count() == 2


def test_compressed_report(spark, tmp_path):
    """Rows and blocks, two copies of all texts, take fewer bytes and say the same."""
    texts = [("pie", f"line {i}\n  été {i % 7}\n" * 40, f"line {i}\n" * 80, i % 2 == 0, i) for i in range(300)] + [(None, None, " ", False, 300), ("pie", "", "a\u2028b", False, 301)]
    df = spark.createDataFrame(texts, "diagram_type string, ground_truth string, prediction string, exact_match boolean, id int")
    found = []
    for codec in (None, "snappy"):
        path = tmp_path / str(codec)
        files.write_eval_report(df, str(path), ["diagram_type", "id"], compression=codec)
        size = sum(f.stat().st_size for part in ("rows", "blocks") for f in (path / part).glob("part-*"))
        lines = [[r.value for r in files.read_lines(spark, str(path / part)).collect()] for part in ("blocks", "header")]
        found.append((size, lines, sorted(map(str, spark.read.schema(df.schema).json(str(path / "rows")).collect()))))
    assert found[0][1:] == found[1][1:] and found[1][0] < found[0][0] / 2


CODES = st.text(alphabet='"ab$\\1 \n', max_size=40)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(CODES, st.lists(st.text(alphabet="xy$\\2", max_size=4), max_size=5)), min_size=20, max_size=40))
def test_substitute_equals_plain_python(spark, cases):
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(cases)], "i int, code string, texts array<string>")
    got = df.select("i", repair.substitute(F.col("code"), F.col("texts")).alias("new"), repair.substitutions(F.col("code"), F.col("texts")).alias("s")).collect()
    for r in got:
        code, texts = cases[r.i]
        left, status = list(texts), []

        def put(m):
            if not left:
                status.append("kept")
                return m.group(0)
            new = left.pop(0)
            status.append("unchanged" if new == m.group(1) else "replaced")
            return f'"{new}"'

        assert r.new == re.sub(r'"([^"]*)"', put, code)
        assert [x.status for x in r.s] == status


def test_reading_order_rounds_halves_to_even(spark):
    boxes = [(5, 30, "d"), (1, 50, "e"), (9, 10, "a"), (2, 29, "b"), (3, 31, "c")]
    items = [([{"x": float(x + dx), "y": float(y + dy)} for dx, dy in ((4, 3), (0, 0))], t, 0.9) for x, y, t in boxes]
    df = spark.createDataFrame([(items,)], "items array<struct<box array<struct<x double, y double>>, text string, confidence double>>".replace("struct<box array", "struct<box: array").replace("<x double, y double>", "<x: double, y: double>").replace("text string, confidence double", "text: string, confidence: double"))
    want = [t for *_, t in sorted([(round(y / 20), x, i, t) for i, (x, y, t) in enumerate(boxes)])]
    assert df.select(repair.reading_order(F.col("items")).alias("t")).first().t == want


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, text.stripped(F.lit("\t  a b \x1f\n"))) == "a b"
    assert one(spark, text.preview(F.lit("a\nb" * 60))) == ("a\nb" * 60).replace("\n", " \\n ")[:70]
    assert [one(spark, text.clock(F.lit(x))) for x in (-5.0, 59.9, 61.0, 3600.0, 86399.0)] == ["0:00", "0:59", "1:01", "1:00:00", "23:59:59"]
    assert one(spark, text.structure_of(F.lit('a["x y"] --> b["z"]'))) == 'a[""] --> b[""]'
    assert one(spark, text.labels_of(F.lit('a "" b "q" c "'))) == ["", "q"]


def test_sequences(spark):
    ids = F.array(*[F.lit(i) for i in (5, 6, 2, 7)])
    assert one(spark, seq.cut_at_eos(ids, None)) == [5, 6, 2, 2]
    assert one(spark, seq.cut_at_eos(ids, 2)) == [5, 6]
    assert one(spark, seq.to_sequence(ids, 4)) == [1, 5, 6, 2]
    assert one(spark, seq.without_special(F.array(*[F.lit(i) for i in (1, 9, 9, 0, 2, 8)]))) == [9, 9, 8]
    assert [one(spark, c) for c in seq.shift_pair(ids)] == [[5, 6, 2], [6, 2, 7]]
    assert one(spark, seq.pad_mask(F.array(F.lit(0), F.lit(4)))) == [False, True]


def test_empty_inputs_do_not_fail(spark):
    none = spark.createDataFrame([], "ground_truth string, prediction string, diagram_type string, t string, p string")
    assert metrics.accuracy(none, "t", "p").first().accuracy is None
    assert metrics.exact_match_rates(metrics.exact_match(none)).first() is None or metrics.exact_match_rates(metrics.exact_match(none)).first().rate is None
    pads = spark.createDataFrame([([0, 0], [0, 0])], "p array<int>, l array<int>")
    assert metrics.token_accuracy(pads, "p", "l").first() == (0, 0, 0.0)


def test_best_epoch_and_flags(spark):
    h = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.4), ("r", 3, 0.4), ("r", 4, 0.3)], "run string, epoch int, val_loss double")
    flags = {r.epoch: r.new_best for r in metrics.best_so_far(h, ["run"], "epoch", "val_loss").collect()}
    assert flags == {1: True, 2: True, 3: False, 4: True}
    ties = h.where("epoch < 4")
    assert metrics.best_epoch(ties, ["run"], "epoch", "val_loss").first().epoch == 2


def test_noise_of_no_strength_is_no_step(spark):
    values = F.array(F.lit(0.5), F.lit(2.0))
    assert vectors.add_noise(values, 0.0, 1, 1) is values
    noisy = one(spark, vectors.add_noise(values, 0.1, 1, 1))
    assert noisy[1] == 1.0 and 0 <= noisy[0] <= 1 and noisy[0] != 0.5


def test_work_folder_comes_from_the_session(spark):
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: folder), sparkContext=SimpleNamespace(master=master, applicationId=master))

    assert work_dir(session("spark://host:7077", "hdfs://shared/work/")) == "hdfs://shared/work"
    assert work_dir(session("local[2]", None)) == work_dir(session("local[2]", None))
    with pytest.raises(ValueError):
        work_dir(session("spark://host:7077", None))


def test_unlisted_classes_stay(spark):
    pairs = spark.createDataFrame([("A", "A"), ("Z", "A"), ("A", "Z"), (None, "B")], "t string, p string")
    got = {r.truth: (r.A, r.B, r.other) for r in metrics.confusion_dense(pairs, "t", "p", ["A", "B"]).collect()}
    assert got == {"A": (1, 0, 1), "B": (0, 0, 0), "other": (1, 1, 0)}
    counts = {r.t: r.n for r in metrics.dense_counts(pairs, "t", ["A", "B"]).collect()}
    assert counts == {"A": 2, "B": 0, "Z": 1, None: 1}


def test_losses_show_what_is_wrong(spark):
    rows = [(1, 4e-7, 2), (1, 4e-7, 2), (2, float("nan"), 1), (2, 0.5, 1), (3, None, 9), (3, 0.5, 1)]
    got = {r.e: r for r in metrics.losses(spark.createDataFrame(rows, "e int, loss double, n long"), "loss", "n", ["e"]).collect()}
    assert got[2].mean_loss != got[2].mean_loss and got[2].weighted_loss != got[2].weighted_loss
    assert got[3].mean_loss == 0.5 and got[3].weighted_loss == 0.5
    assert got[1].mean_loss == 0.0, "six decimals are reported"


def test_missing_losses_are_never_best(spark):
    rows = [("r", 1, None, 1.0), ("r", 2, 0.5, 1.0), ("r", 3, float("nan"), 1.0), ("s", 1, None, 1.0)]
    history = spark.createDataFrame(rows, "run string, epoch int, val double, train double")
    got = {r.run: r for r in metrics.best_epoch(history, ["run"], "epoch", "val").collect()}
    assert (got["r"].epoch, got["r"].val) == (2, 0.5) and got["s"].epoch is None
    assert {r.run: r.best_epoch for r in metrics.overfit_onset(history, ["run"], "epoch", "train", "val").collect()} == {"r": 2, "s": None}


def test_total_is_marked(spark):
    rows = spark.createDataFrame([(None, True), (None, False), ("a", True)], "diagram_type string, exact_match boolean")
    got = {(r.diagram_type, r.is_total): r.n for r in metrics.exact_match_rates(rows).collect()}
    assert got == {(None, True): 3, (None, False): 2, ("a", False): 1}


def test_gate_counts_rows_without_class(spark):
    rows = spark.createDataFrame([(1, 3), (2, 0), (3, None)], "id int, pred int")
    assert [r.id for r in classify.gate(rows, "pred", [3]).collect()] == [2]
    assert sorted(r.id for r in classify.gate_rejects(rows, "pred", [3]).collect()) == [1, 3]
