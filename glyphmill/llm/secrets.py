"""Operator 2: secrets by fixed patterns, and multipart credentials by an interval join.

Parts of a credential have a role: identifier, secret or endpoint. Parts found by
a strong pattern are always reported. Weak parts (a login, a bare 40-character
key, an address) mean little alone; one is reported only when a part of another
role stands within ``reach`` code points, its scope. That is an interval join
inside each document: every part covers the cells of width ``reach`` that its
scope touches, and a weak part semi-joins the cells it stands in, so no cell
ever gives all its pairs.

Everything is DataFrame functions. Only documents in which a short test finds
anything are searched closely. Null texts count as empty, and so does a text
without parts: it has no spans. Rows with the same doc_id and text get the same
result each; a null doc_id stays null. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import materialise

#: kind: (role, strong, pattern, group whose length counts, least length)
KINDS = {
    "assign": ("secret", True, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("identifier", True, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": ("secret", True, r"[0-9a-f]+", 0, 24),
    "login": ("identifier", False, r"""(?i:(user|username|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 2, 3),
    "key40": ("secret", False, r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    "address": ("endpoint", False, r"https?://[A-Za-z0-9.:/_-]+", 0, 10),
}
#: A text without this has no part at all.
ANY = r"(?i:passw|secret|token|api_?key|AKIA|user|login|client_?id|account|https?://)|[0-9a-f]{24}|[A-Za-z0-9+/]{40}"
REACH = 200
BASE = ("assign", "access", "hex")


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, end) in code points; those with a short ``group`` are dropped.

    The places follow from the lengths of the matches and of the texts between them.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(between, F.lit(1), F.size(whole)).alias("before"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        end = start + F.length(x["whole"])
        item = F.struct(start.alias("start"), end.alias("end"))
        kept = F.when(F.length(x["part"]) >= least, F.array_append(state["found"], item)).otherwise(state["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"])


def run_from(kind: str) -> str:
    """The pattern of a kind. A run of hexadecimal digits is a whole match, so its least length can stand in the pattern."""
    return f"[0-9a-f]{{{KINDS[kind][4]},}}" if kind == "hex" else KINDS[kind][2]


def typed(found: Column, kind: str) -> Column:
    role, strong = KINDS[kind][:2]

    def item(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), F.lit(list(KINDS).index(kind)).alias("place"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(strong).alias("strong"),
        )

    return F.transform(found, item)


def parts(docs: DataFrame) -> DataFrame:
    """All parts of all texts: (key, kind, role, strong, start, end); hexadecimal runs only from 24 characters on."""
    held = docs.filter(F.col("text").rlike(ANY)).select(F.xxhash64("doc_id", "text").alias("key"), "text").dropDuplicates(["key"])
    found = [typed(spans(F.col("text"), run_from(kind), group, least), kind) for kind, (_, _, _, group, least) in KINDS.items()]
    return held.select("key", F.explode(F.concat(*found)).alias("p")).select("key", "p.*")


def cells(low: Column, high: Column, reach: int) -> Column:
    return F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach)))


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts that have a part of another role within ``reach`` code points."""
    weak = found.filter(~F.col("strong"))
    scopes = found.select(
        F.col("key").alias("k"), F.col("role").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"),
        cells(F.col("start") - reach, F.col("end") + reach, reach).alias("c"),
    )
    standing = weak.withColumn("cell", cells(F.col("start"), F.col("end"), reach))
    meets = (
        (F.col("key") == F.col("k")) & (F.col("cell") == F.col("c")) & (F.col("role") != F.col("r"))
        & (F.col("s") <= F.col("end") + reach) & (F.col("start") <= F.col("e") + reach)
    )
    return standing.join(scopes, meets, "left_semi").drop("cell").distinct()


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of (start, place, end, kind, role, strong)
    in order of start, then of kind as listed in ``KINDS``."""
    found = materialise(parts(docs), "secret-parts")
    kept = found.filter("strong").unionByName(linked(found, reach))
    item = F.struct("start", "place", "end", "kind", "role", "strong")
    each = kept.groupBy("key").agg(F.sort_array(F.collect_set(item)).alias("spans"))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"))
    none = F.array().cast(each.schema["spans"].dataType)
    return keyed.join(each, "key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def told(items: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
