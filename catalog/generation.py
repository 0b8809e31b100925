"""Generation: draws, templates, styles, profiles, coverage. Rows come from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.grammar_sql import GRAMMAR, G, arr, negative, u32 as sql_u32
from catalog.registry import query, table
from glyphmill.functions.draws import Draws, cat, lines, u32, upto
from glyphmill.operators.running import with_rank
from glyphmill.plans import corpus, grammars, vocabulary as v
from glyphmill.session import spread


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "source"))


@query("gen_draw", f"""
    SELECT event_id, {sql_u32("42", "'draw'", "event_id", "'slot'")} AS value,
      event_id % 4 AS worker, (42 + event_id % 4)::BIGINT * 1000003 + event_id % 7 AS worker_seed FROM events""")
def gen_draw(spark, sf):
    ev = table(spark, sf, "events")
    worker = F.col("event_id") % 4
    return ev.select(
        "event_id", u32(42, "draw", F.col("event_id"), "slot").alias("value"), worker.alias("worker"),
        corpus.worker_seed(42 + worker, F.col("event_id") % 7).alias("worker_seed"),
    )


g = G("event_id", "'scalar'")
DECK = ["a", "b", "c", "d", "e", "f"]


@query("gen_choice", f"SELECT event_id, {g.pick(v.THEMES, chr(39) + 'c' + chr(39))} AS theme FROM events")
def gen_choice(spark, sf):
    d = Draws(42, "scalar", F.col("event_id"))
    return table(spark, sf, "events").select("event_id", d.choice(v.THEMES, "c").alias("theme"))


@query("gen_randint", f"SELECT event_id, {g.rnd(5, 100, chr(39) + 'r' + chr(39))}::INTEGER AS value FROM events")
def gen_randint(spark, sf):
    d = Draws(42, "scalar", F.col("event_id"))
    return table(spark, sf, "events").select("event_id", d.randint(5, 100, "r").alias("value"))


@query("gen_weighted_choice", f"""
    SELECT event_id, CASE WHEN p < 12 THEN 'process' WHEN p < 14 THEN 'decision' ELSE 'io' END AS kind
    FROM (SELECT event_id, {g.u("'w'")} % 15 AS p FROM events)""")
def gen_weighted_choice(spark, sf):
    d = Draws(42, "scalar", F.col("event_id"))
    kinds = [("process", 12), ("decision", 2), ("io", 1)]
    return table(spark, sf, "events").select("event_id", d.weighted(kinds, "w").alias("kind"))


@query("gen_sample", f"SELECT event_id, array_to_string({g.sample(DECK, 3, chr(39) + 's' + chr(39))}, ',') AS picked FROM events")
def gen_sample(spark, sf):
    d = Draws(42, "scalar", F.col("event_id"))
    return table(spark, sf, "events").select("event_id", F.array_join(d.sample(DECK, F.lit(3), "s"), ",").alias("picked"))


@query("gen_uniform_2dp", f"SELECT event_id, '0.' || printf('%02d', {g.rnd(2, 97, chr(39) + 'u' + chr(39))}) AS share FROM events")
def gen_uniform_2dp(spark, sf):
    d = Draws(42, "scalar", F.col("event_id"))
    return table(spark, sf, "events").select("event_id", d.hundredths("u").alias("share"))


def one_type(name):
    @query(f"gen_{name}", f"SELECT doc_id, {GRAMMAR[name](G('doc_id', chr(39) + name + chr(39)))} AS target FROM documents")
    def run(spark, sf):
        return docs(spark, sf).select("doc_id", corpus.text_of(name, F.col("doc_id"), 42).alias("target"))


for type_name in v.DIAGRAM_TYPES:
    one_type(type_name)


@query("gen_not_diagram", f"SELECT doc_id, {negative(G('doc_id', chr(39) + 'not_diagram' + chr(39)))} AS target FROM documents")
def gen_not_diagram(spark, sf):
    return docs(spark, sf).select("doc_id", corpus.text_of(v.NEGATIVE_CLASS, F.col("doc_id"), 42).alias("target"))


def all_types_sql(rows: str, row: str, seed: str, types=v.DIAGRAM_TYPES) -> str:
    parts = [
        f"SELECT {row}, '{t}' AS diagram_type, {(negative if t == v.NEGATIVE_CLASS else GRAMMAR[t])(G(row, chr(39) + t + chr(39), seed))} AS target FROM {rows}"
        for t in types
    ]
    return "(" + " UNION ALL ".join(parts) + ")"


@query("gen_corpus", f"SELECT doc_id, diagram_type, md5(target) AS text_md5, length(target) AS chars FROM {all_types_sql('documents', 'doc_id', '42')}")
def gen_corpus(spark, sf):
    made = corpus.generate(docs(spark, sf), "doc_id", 42)
    return made.select("doc_id", "diagram_type", F.md5("target").alias("text_md5"), F.length("target").cast("bigint").alias("chars"))


s = G("doc_id", "'style'")


@query("gen_style", f"""
    SELECT doc_id, {s.pick(v.THEMES, "'theme'")} AS theme, {s.pick(v.LOOKS, "'look'")} AS look,
      {s.pick(v.WIDTHS, "'width'")} AS width, {s.pick(['quickjs', 'v8'], "'engine'")} AS engine FROM documents""")
def gen_style(spark, sf):
    d = Draws(42, "style", F.col("doc_id"))
    return docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in corpus.style(d, ("quickjs", "v8")).items()])


@query("gen_frontmatter", f"""
    SELECT doc_id, target, '---' || chr(10) || 'config:' || chr(10) || '  theme: ' || theme || chr(10) || '  look: ' || look
      || chr(10) || '---' || chr(10) || target AS wrapped
    FROM (SELECT doc_id, {GRAMMAR['pie'](G('doc_id', "'pie'"))} AS target, {s.pick(v.THEMES, "'theme'")} AS theme,
      {s.pick(v.LOOKS, "'look'")} AS look FROM documents)""")
def gen_frontmatter(spark, sf):
    d = Draws(42, "style", F.col("doc_id"))
    made = docs(spark, sf).select("doc_id", corpus.text_of("pie", F.col("doc_id"), 42).alias("target"))
    look = corpus.style(d)
    return made.withColumn("wrapped", corpus.with_frontmatter(F.col("target"), look["theme"], look["look"]))


@query("gen_fixed_testset", "SELECT item_id, diagram_type, target, 'default' AS theme, 'classic' AS look, 800 AS width FROM ("
       + " UNION ALL ".join(f"SELECT item_id, '{t}' AS diagram_type, {GRAMMAR[t](G('0', chr(39) + t + chr(39), '(1234 + item_id)'))} AS target FROM benchmark" for t in v.DIAGRAM_TYPES) + ")")
def gen_fixed_testset(spark, sf):
    """One fixed set per seed; seeds count up from the usual one."""
    seeds = spread(table(spark, sf, "benchmark").select("item_id", (F.col("item_id") + v.FIXED_SET_SEED).alias("seed")))
    return corpus.fixed_testset(seeds, "seed").select((F.col("seed") - v.FIXED_SET_SEED).alias("item_id"), "diagram_type", "target", "theme", "look", "width")


@query("gen_row_names", """
    SELECT doc_id, printf('%s_%05d.png', source, i) AS file_name, printf('%s_val_%05d.png', source, i) AS val_name
    FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)""")
def gen_row_names(spark, sf):
    ranked = with_rank(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], "place")
    index = F.col("place") - 1
    return ranked.select(
        "doc_id", corpus.file_name(F.col("source"), index).alias("file_name"),
        corpus.file_name(F.col("source"), index, val=True).alias("val_name"),
    )


WELL_FORMED_SQL = """(length(trim(html)) > 0 AND (length(html) - length(replace(html, '"', ''))) % 2 = 0)"""


@query("gen_skip_policy", f"SELECT page_id, CASE WHEN {WELL_FORMED_SQL} THEN 'good' ELSE 'reject' END AS fate FROM pages")
def gen_skip_policy(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    good, bad = corpus.good_and_rejects(pages, corpus.well_formed(F.col("html")))
    return good.select("page_id", F.lit("good").alias("fate")).unionByName(bad.select("page_id", F.lit("reject").alias("fate")))


REQUESTED = ["click", "view", "error", "purchase", "refund"]


@query("gen_coverage", f"""
    SELECT event_type, coalesce(ok, 0) AS ok, coalesce(n, 0) AS requested FROM (SELECT unnest({arr(REQUESTED)}) AS event_type) r
    FULL JOIN (SELECT event_type, count(*) FILTER (WHERE whole) AS ok, count(*) AS n FROM
      (SELECT event_type, {sql_u32("'img'", 'event_id')} % 10 <> 0 AS whole FROM events) GROUP BY 1) f USING (event_type)""")
def gen_coverage(spark, sf):
    ev = table(spark, sf, "events").withColumn("whole", u32("img", F.col("event_id")) % 10 != 0)
    return corpus.coverage(ev, "event_type", REQUESTED, F.col("whole"))


def profiles_sql() -> str:
    offsets = {"router": 0, "val": 1, "corpus": 2, "fixed": 1}
    parts = []
    for name, offset in offsets.items():
        types = ([v.NEGATIVE_CLASS] if name == "router" else []) + v.DIAGRAM_TYPES
        pattern = "%s_val_%05d.png" if name == "val" else "%s_%05d.png"
        parts.append(
            f"SELECT '{name}' AS profile, diagram_type, doc_id, target, printf('{pattern}', diagram_type, doc_id) AS file_name "
            f"FROM {all_types_sql('documents', 'doc_id', str(42 + offset), types)}"
        )
    return " UNION ALL ".join(parts)


@query("gen_profiles", f"""
    SELECT profile, diagram_type, count(*) AS n, count(DISTINCT md5(target)) AS texts, sum(length(target))::BIGINT AS chars,
      sum({sql_u32('target')})::BIGINT AS text_sum, sum({sql_u32('file_name')})::BIGINT AS name_sum FROM ({profiles_sql()}) GROUP BY 1, 2""")
def gen_profiles(spark, sf):
    made = corpus.profiles(docs(spark, sf), "doc_id", 42, dict.fromkeys(corpus.SEED_OFFSETS))
    return made.groupBy("profile", "diagram_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.md5("target")).alias("texts"), F.sum(F.length("target")).alias("chars"),
        F.sum(u32(F.col("target"))).alias("text_sum"), F.sum(u32(F.col("file_name"))).alias("name_sum"),
    )


e = G("event_id", "'style'")


@query("gen_provenance", f"""
    SELECT event_id, event_type AS diagram_type, {e.pick(v.THEMES, "'theme'")} AS theme, {e.pick(v.LOOKS, "'look'")} AS look,
      {e.pick(v.WIDTHS, "'width'")} AS width, {e.pick(['quickjs'], "'engine'")} AS engine,
      (user_id % 4)::INTEGER AS worker_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS written_at FROM events""")
def gen_provenance(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("event_type").alias("diagram_type"), "user_id", "ts")
    made = corpus.with_provenance(ev, 42, "event_id", F.col("user_id") % 4, F.col("ts").cast("timestamp"))
    return made.select(
        "event_id", "diagram_type", "theme", "look", "width", "engine", "worker_id", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("written_at")
    )


@query("udf_registered_template", f"""
    SELECT doc_id, 'checklist' AS diagram_type, array_to_string(['checklist'] || list_transform(range(0, {G('doc_id', "'checklist'").rnd(1, 4, "'n'")}),
      lambda i: concat('  - ', {G('doc_id', "'checklist'").label("'item'", 'i')})), chr(10)) AS target FROM documents""")
def udf_registered_template(spark, sf):
    """A new type is one function; corpus generation picks it up by name."""

    def checklist(d, w):
        return lines("checklist", upto(d.randint(1, 4, "n"), 4, lambda i: cat("  - ", grammars.label(d, w, "item", i))))

    return corpus.generate(docs(spark, sf), "doc_id", 42, ["checklist"], templates={**grammars.TEMPLATES, "checklist": checklist})


LONG_VERBS = [f"{a}{b}" for a in ("Re", "Pre", "Un") for b in ("load", "check", "build", "parse")]


@query("gen_vocabulary_parameter", f"SELECT doc_id, {GRAMMAR['timeline'](G('doc_id', chr(39) + 'timeline' + chr(39), verbs=LONG_VERBS))} AS target FROM documents")
def gen_vocabulary_parameter(spark, sf):
    """Richer labels come from other word lists, given as a parameter."""
    words = v.Words(verbs=LONG_VERBS)
    return docs(spark, sf).select("doc_id", corpus.text_of("timeline", F.col("doc_id"), 42, words).alias("target"))
