"""Inputs the given tables stand in for, derived alike in Spark and in SQL.

All draws are ``u32``: the first 32 bits of the md5 of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.grammar_sql import u32 as sql_u32
from catalog.registry import table
from glyphmill.functions.draws import u32
from glyphmill.functions.text import labels_of
from glyphmill.session import spread

CLASSES = ["A", "N", "R"]  # l_returnflag


# --- predictions: documents with some words changed -------------------------------


def predictions(spark: SparkSession, sf: str, salt: str = "pred") -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    changed = F.transform(
        F.split("text", " "),
        lambda w, i: F.when(u32(salt, F.col("doc_id"), i) % 10 == 0, F.concat(w, F.lit("~"))).otherwise(w),
    )
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), "text", F.lit("\n"))).otherwise(F.array_join(changed, " "))
    return docs.select(
        "doc_id", F.col("source").alias("diagram_type"), F.col("text").alias("ground_truth"), text.alias("prediction")
    )


def predictions_sql(salt: str = "pred") -> str:
    return f"""(SELECT doc_id, source AS diagram_type, text AS ground_truth,
      CASE WHEN doc_id % 5 = 0 THEN ' ' || text || chr(10) ELSE array_to_string(list_transform(string_split(text, ' '),
        lambda w, i: CASE WHEN {sql_u32(f"'{salt}'", 'doc_id', 'i - 1')} % 10 = 0 THEN w || '~' ELSE w END), ' ') END AS prediction
      FROM documents)"""


SQL_BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_BLANKS}+|{SQL_BLANKS}+$', '', 'g')"


# --- token ids: one id per word ----------------------------------------------------


def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    ids = F.transform(F.split("text", " "), lambda w: (u32("tok", w) % 5996 + 4).cast("int"))
    return docs.select("doc_id", "source", ids.alias("ids"))


TOKEN_IDS_SQL = f"""(SELECT doc_id, source, list_transform(string_split(text, ' '),
  lambda w: ({sql_u32("'tok'", 'w')} % 5996 + 4)::INTEGER) AS ids FROM documents)"""


# --- text boxes read from a picture of each page ------------------------------------


def ocr_items(spark: SparkSession, sf: str) -> DataFrame:
    """One box per label, except that some pages lose the last and some gain one."""
    pages = spread(table(spark, sf, "pages").select("page_id", "html")).withColumn("labels", labels_of(F.col("html")))
    lost = F.slice("labels", F.lit(1), F.greatest(F.size("labels") - 1, F.lit(0)))
    texts = F.when(F.col("page_id") % 3 == 0, lost).when(
        F.col("page_id") % 3 == 1, F.col("labels")
    ).otherwise(F.concat("labels", F.array(F.lit("extra"))))

    def box(t: Column, i: Column) -> Column:
        x = (u32("x", F.col("page_id"), i) % 800).cast("double")
        y = (u32("y", F.col("page_id"), i) % 60 * 10).cast("double")
        points = [F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (50, 0), (50, 10), (0, 10))]
        shown = F.when(u32("ocr", F.col("page_id"), i) % 2 == 0, F.concat(t, F.lit("*"))).otherwise(t)
        return F.struct(F.array(*points).alias("box"), shown.alias("text"), F.lit(0.9).alias("confidence"))

    return pages.select("page_id", "html", F.transform(texts, box).alias("items"))


OCR_SQL = f"""(SELECT page_id, html, labels, list_transform(texts, lambda t, i: {{
    'row': round_even((({sql_u32("'y'", 'page_id', 'i - 1')} % 60 * 10)::DOUBLE) / 20, 0),
    'x': ({sql_u32("'x'", 'page_id', 'i - 1')} % 800)::DOUBLE, 'pos': i,
    'text': CASE WHEN {sql_u32("'ocr'", 'page_id', 'i - 1')} % 2 = 0 THEN t || '*' ELSE t END}}) AS items
  FROM (SELECT page_id, html, labels, CASE page_id % 3 WHEN 0 THEN list_slice(labels, 1, greatest(len(labels) - 1, 0))
      WHEN 1 THEN labels ELSE list_append(labels, 'extra') END AS texts
    FROM (SELECT page_id, html, regexp_extract_all(html, '"([^"]*)"', 1) AS labels FROM pages)))"""
TEXTS_SQL = f"""(SELECT page_id, html, labels, list_transform(list_sort(items), lambda s: s.text) AS texts FROM {OCR_SQL})"""


# --- a classifier's answers over lineitem ---------------------------------------------


def answers(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("truth"))
    point = u32("cls", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"))
    classes = F.array(*[F.lit(c) for c in CLASSES])
    pred = F.when(point % 10 < 7, F.col("truth")).otherwise(F.element_at(classes, (point % 3 + 1).cast("int")))
    return line.withColumn("pred", pred)


ANSWERS_SQL = f"""(SELECT *, CASE WHEN p % 10 < 7 THEN truth ELSE (['A','N','R'])[p % 3 + 1] END AS pred
  FROM (SELECT l_orderkey, l_returnflag AS truth, {sql_u32("'cls'", 'l_orderkey', 'l_linenumber', 'l_suppkey')} AS p FROM lineitem))"""


# --- training log over events: epoch is a day, step an event -----------------------------


def steps(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", ts)
    correct = u32("ok", F.col("event_id")) % 101
    return ev.select(
        "event_id", F.dayofyear(ts).alias("epoch"), F.col("value").alias("loss"), correct.alias("correct"),
        F.lit(100).cast("bigint").alias("total"),
        ((F.unix_micros(ts) - F.unix_micros(day)) / F.lit(1e6)).alias("elapsed"),
    )


STEPS_SQL = f"""(SELECT event_id, dayofyear(ts)::INTEGER AS epoch, value AS loss, {sql_u32("'ok'", 'event_id')} % 101 AS correct,
  100::BIGINT AS total, (epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP))::DOUBLE / 1e6 AS elapsed FROM events)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    """One row per epoch (day) and run (event type)."""
    ev = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    cents = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    train = F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value").cast("decimal(18,2)"))).cast("double")
    return ev.groupBy(F.col("event_type").alias("run"), F.dayofyear(ts).alias("epoch")).agg(
        (cents / F.count(F.lit(1))).alias("val_loss"),
        (F.coalesce(train, F.lit(0.0)) / F.count(F.lit(1))).alias("train_loss"),
        F.count(F.lit(1)).alias("steps"),
        (F.count(F.lit(1)) * 3 + F.dayofyear(F.max(ts)).cast("bigint")).alias("seconds"),
    )


HISTORY_SQL = """(SELECT event_type AS run, dayofyear(ts)::INTEGER AS epoch,
    sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS val_loss,
    coalesce(sum(CASE WHEN user_id % 2 = 0 THEN value::DECIMAL(18,2) END)::DOUBLE, 0) / count(*) AS train_loss,
    count(*) AS steps, (count(*) * 3 + max(dayofyear(ts)))::BIGINT AS seconds FROM events GROUP BY 1, 2)"""


# --- samples with a payload over events -----------------------------------------------------

SIGNATURE, END = "89504E470D0A1A0A", "49454E44AE426082"  # fixed values of the PNG format


def images(spark: SparkSession, sf: str) -> DataFrame:
    """A minimal picture per event, some cut short, with a JSON note, some broken or missing."""
    ev = table(spark, sf, "events")
    point = u32("img", F.col("event_id"))
    width = F.element_at(F.array(F.lit(600), F.lit(800), F.lit(1000)), (point % 3 + 1).cast("int"))
    content = F.unhex(F.concat(
        F.lit(SIGNATURE + "0000000D49484452"), F.lpad(F.hex(width), 8, "0"), F.lpad(F.hex((point % 500 + 100)), 8, "0"),
        F.when(point % 10 == 0, F.lit("08020000")).otherwise(F.lit("0802000000000000000000000" + "0" + END)),
    ))
    note = F.concat(
        F.lit('{"diagram_type":"'), "event_type", F.lit('","worker_id":'), (F.col("user_id") % 4).cast("string"),
        F.when(point % 11 == 0, F.lit(',"target"')).otherwise(F.lit(',"target":"x"}')),
    )
    return ev.select(
        F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("stem"), "event_id", "event_type",
        content.alias("content"), F.when(point % 13 != 0, note).alias("note"),
    )


IMAGES_SQL = f"""(SELECT event_id, 'w' || event_id AS stem, event_type, ([600,800,1000])[p % 3 + 1] AS width,
    p % 500 + 100 AS height, p % 10 <> 0 AS whole, p % 13 <> 0 AS has_note, p % 13 <> 0 AND p % 11 <> 0 AS good_note,
    CASE WHEN p % 13 = 0 OR p % 11 = 0 THEN 'missing_meta' WHEN p % 10 = 0 THEN 'corrupt' ELSE 'ok' END AS status
  FROM (SELECT *, {sql_u32("'img'", 'event_id')} AS p FROM events))"""
