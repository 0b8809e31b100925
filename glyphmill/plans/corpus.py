"""Seeded corpus generation: narrow plans from row numbers to labelled texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.draws import Draws, Part, cat
from glyphmill.plans.grammars import TEMPLATES, Template, negative_text
from glyphmill.plans.vocabulary import LOOKS, NEGATIVE_CLASS, THEMES, WIDTHS, Words

# Seeds of the profiles, relative to the run's seed (fixed values).
SEED_OFFSETS = {"router": 0, "val": 1, "corpus": 2, "fixed": 1}
# Default rows per type of each profile (fixed values).
PROFILE_ROWS = {"router": 300, "val": 60, "corpus": 2000, "fixed": 400}
WORKER_SEED_STEP = 1_000_003


def worker_seed(seed: Part, worker: Part) -> Column:
    """Seed of one producer, so that producers draw different samples."""
    base = seed if isinstance(seed, Column) else F.lit(seed)
    return base.cast("bigint") * WORKER_SEED_STEP + worker


def text_of(name: str, row: Column, seed: Part, words: Words = Words(), templates: Mapping[str, Template] = TEMPLATES) -> Column:
    """Text of one type for the given row; the class without diagrams gets prose."""
    d = Draws(seed, name, row)
    return negative_text(d) if name == NEGATIVE_CLASS else templates[name](d, words)


def generate(
    rows: DataFrame, row: str, seed: Part, types: Sequence[str] | None = None,
    words: Words = Words(), templates: Mapping[str, Template] = TEMPLATES,
) -> DataFrame:
    """One text per input row and type: (row, diagram_type, target). No shuffle."""
    names = list(types or templates)
    made = F.array(
        *[F.struct(F.lit(n).alias("diagram_type"), text_of(n, F.col(row), seed, words, templates).alias("target")) for n in names]
    )
    return rows.select(row, F.explode(made).alias("made")).select(row, "made.*")


def sample_of_any_type(row: Column, seed: Part, words: Words = Words(), templates: Mapping[str, Template] = TEMPLATES) -> tuple[Column, Column]:
    """(type, text) of one endless-stream sample: a uniform type, then its text."""
    names = list(templates)
    chosen = Draws(seed, "type", row).choice(names, "type")
    text = F.lit(None).cast("string")
    for n in reversed(names):
        text = F.when(F.col("diagram_type") == n, text_of(n, row, seed, words, templates)).otherwise(text)
    return chosen, text


def with_samples(rows: DataFrame, row: str, seed: Part, words: Words = Words(), templates: Mapping[str, Template] = TEMPLATES) -> DataFrame:
    """Add ``diagram_type`` and ``target`` of a random type; works on streams too."""
    chosen, text = sample_of_any_type(F.col(row), seed, words, templates)
    return rows.withColumn("diagram_type", chosen).withColumn("target", text)


def style(d: Draws, engines: Sequence[str] = ("quickjs",)) -> dict[str, Column]:
    return {
        "theme": d.choice(THEMES, "theme"),
        "look": d.choice(LOOKS, "look"),
        "width": d.choice(WIDTHS, "width"),
        "engine": d.choice(list(engines), "engine"),
    }


def with_frontmatter(target: Column, theme: Column, look: Column) -> Column:
    """Text with its style header; the clean text stays the target."""
    return cat("---\nconfig:\n  theme: ", theme, "\n  look: ", look, "\n---\n", target)


def file_name(name: Column, index: Column, val: bool = False) -> Column:
    return F.format_string("%s_val_%05d.png" if val else "%s_%05d.png", name, index)


def fixed_testset(seeds: DataFrame, seed: str, words: Words = Words()) -> DataFrame:
    """One text per type and seed, plain style. Row 0 and a stream per type, so the
    order of the types does not matter."""
    made = F.array(
        *[F.struct(F.lit(n).alias("diagram_type"), text_of(n, F.lit(0), F.col(seed), words).alias("target")) for n in TEMPLATES]
    )
    return (
        seeds.select(seed, F.explode(made).alias("made")).select(seed, "made.*")
        .withColumns({"theme": F.lit("default"), "look": F.lit("classic"), "width": F.lit(800)})
    )


def profiles(
    rows: DataFrame, row: str, seed: int, sizes: Mapping[str, int | None], words: Words = Words()
) -> DataFrame:
    """All corpus profiles in one narrow pass: their seeds, classes and file names.

    ``sizes`` names the profiles to make (leave one out to skip it) and how many
    rows per class each gets; None means every input row.
    """
    groups: dict[int, list[Column]] = {}
    for n, size in sizes.items():
        groups.setdefault(seed + SEED_OFFSETS[n], []).append(F.struct(F.lit(n).alias("profile"), F.lit(size).cast("bigint").alias("size")))
    # Profiles of one seed have the same texts, which are made once for all of them.
    wanted = F.array(*[F.struct(F.lit(s).alias("seed"), F.array(*asked).alias("all")) for s, asked in groups.items()])
    asked = rows.select(row, F.explode(wanted).alias("p")).select(
        row, "p.seed", F.filter("p.all", lambda x: x["size"].isNull() | (F.col(row) < x["size"]))["profile"].alias("all")
    ).where(F.size("all") > 0)

    def entry(name: str) -> Column:
        text = text_of(name, F.col(row), F.col("seed"), words)
        if name == NEGATIVE_CLASS:  # only the classifier learns what is no diagram
            text = F.when(F.array_contains("all", "router"), text)
        return F.struct(F.lit(name).alias("diagram_type"), text.alias("target"))

    made = F.array(*[entry(n) for n in [NEGATIVE_CLASS, *TEMPLATES]])
    kind, val = F.col("diagram_type"), F.col("profile") == "val"
    return (
        asked.select("all", row, F.explode(made).alias("made")).select("all", row, "made.*")
        .where(F.col("target").isNotNull())
        .select(F.explode("all").alias("profile"), row, "diagram_type", "target")
        .where((kind != NEGATIVE_CLASS) | (F.col("profile") == "router"))
        .withColumn("file_name", F.when(val, file_name(kind, F.col(row), val=True)).otherwise(file_name(kind, F.col(row))))
    )


def default_profiles(spark: SparkSession, seed: int = 0, words: Words = Words()) -> DataFrame:
    """The profiles in their usual sizes."""
    return profiles(spark.range(max(PROFILE_ROWS.values())), "id", seed, PROFILE_ROWS, words)


def well_formed(text: Column) -> Column:
    """Rows that can be used: some text, and every quoted label closed."""
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return F.coalesce((F.length(F.trim(text)) > 0) & (quotes % 2 == 0), F.lit(False))


def good_and_rejects(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Bad rows are set aside and counted, never fatal."""
    kept = F.coalesce(valid, F.lit(False))
    return df.where(kept), df.where(~kept)


def coverage(df: DataFrame, by: str, requested: Sequence[str], ok: Column) -> DataFrame:
    """ok / asked per requested class; classes without rows stay, with 0, and so do classes nobody requested.

    ``requested`` is the class contract, a short list given by the caller.
    """
    found = df.groupBy(by).agg(F.count_if(ok).alias("ok"), F.count(F.lit(1)).alias("requested"))
    wanted = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in requested])).alias(by))
    return wanted.join(found, by, "full_outer").select(
        by, F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("requested", F.lit(0)).alias("requested")
    )


def with_provenance(df: DataFrame, seed: Part, row: str, worker: Column, written_at: Column | None = None, engines: Sequence[str] = ("quickjs",)) -> DataFrame:
    """Add style, worker, engine and time of writing to generated samples."""
    return df.withColumns(
        {**style(Draws(seed, "style", F.col(row)), engines), "worker_id": worker.cast("int"),
         "written_at": F.current_timestamp() if written_at is None else written_at}
    )
