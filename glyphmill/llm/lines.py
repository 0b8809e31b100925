"""Operator 6: line dedup by an exact set-similarity join.

A line's tokens are its distinct five-word shingles, or all its words as one token
where it has fewer. Two lines match when their token sets share at least 0.8 of
their union. A line goes when an earlier line of the table matches it, earlier by
doc_id, then by place in the text; whether that one goes too does not matter. So
of any lines that are equal or alike, the first one stays, and the result does
not depend on how the work is spread.

Lines are compared as sets first: equal sets are grouped by a hash and only each
group's first line goes on. Those meet through an inverted index of prefixes of
their rarest tokens (see ``setjoin``), are filtered by size and by the places of the
shared token, and verified by all their tokens. In a crowd of lines alike, the
earliest line of a list is compared with the others first, and only lines that
this leaves are compared further.

All of it is DataFrame functions. Lines without words never go and match nothing.
Null texts stay null, empty ones empty. Rows of equal doc_id and text are one
document: each gets the same text back. Null ids come first. Rows of one doc_id
and different texts stand in the order of the texts' hashes. Extra columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import let, words
from glyphmill.llm.setjoin import FREQUENT, candidates, could, led, met_within, placed, reserve_length, similar, windows
from glyphmill.session import materialise

SIZE = 5


def tokens(line: Column) -> Column:
    """The line's shingle hashes, ascending and distinct; none for a line without words."""
    plain = F.array_remove(F.split(line, " "), "")  # no regular expression where blanks are the only white space
    every = F.when(line.rlike(r"[\x09\x0B\x0C\x0D]"), words(line)).otherwise(plain)

    def shingles(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - SIZE)
        return F.transform(places, lambda i: F.xxhash64(*[h[i + k] for k in range(SIZE)]))

    def of(h: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= SIZE, shingles(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)

    return F.sort_array(F.array_distinct(let(F.transform(every, lambda w: F.xxhash64(w)), of)))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, line_no, line): every line of every row; ``copy`` is a hash of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


PLACE = ("doc_id", "copy", "line_no")


def with_sets(lines: DataFrame) -> DataFrame:
    """Lines as (place, node, n, tokens): ``node`` is a hash of the whole set."""
    return lines.withColumn("all", tokens(F.col("line"))).select(
        F.struct(*PLACE).alias("place"), F.xxhash64("all").alias("node"), F.size("all").alias("n"), "all"
    )


def repeated(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The places (doc_id, copy, line_no) of lines that go, once for each."""
    docs = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    every = with_sets(lines_of(docs))
    every = materialise(every.select("place", "node", "n", F.slice("all", F.lit(1), reserve_length(F.col("n"))).alias("tokens")), "line-sets")
    held = every.filter("n > 0")
    first = held.groupBy("node").agg(F.min("place").alias("place"), F.count("*").alias("lines"))
    first = materialise(first, "first-lines")
    def full(nodes: DataFrame) -> DataFrame:
        """All tokens of some lines, from the texts of the documents they first stand in."""
        wanted = materialise(first.join(nodes, "node").select("node", "place.*"), "wanted-lines")
        ids = materialise(wanted.select("doc_id").distinct(), "wanted-documents")
        some = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        at = wanted.select(*[F.col(c).alias(f"_{c}") for c in PLACE])
        found = lines_of(some)
        same = found["doc_id"].eqNullSafe(at["_doc_id"]) & (found["copy"] == at["_copy"]) & (found["line_no"] == at["_line_no"])
        sets = with_sets(found.join(at, same, "left_semi"))
        return sets.select("node", "n", F.col("all").alias("tokens")).dropDuplicates(["node"])

    rank = first.select("node", F.col("place").alias("rank"))

    def later(pairs: DataFrame) -> DataFrame:
        """The later node of each pair."""
        ends = pairs.join(rank.withColumnsRenamed({"node": "x", "rank": "rx"}), "x").join(rank.withColumnsRenamed({"node": "y", "rank": "ry"}), "y")
        return ends.select(F.when(F.col("rx") < F.col("ry"), F.col("y")).otherwise(F.col("x")).alias("node"))

    pairs, lists = candidates(held, full, frequent)
    stars = led(lists, rank)
    gone = materialise(later(similar(pairs.unionByName(stars).distinct(), full)).distinct(), "alike-lines")
    # Members that their list's leader did not settle look for an earlier member, each time farther off in the list.
    places = placed(lists)
    places = materialise(places.join(rank.withColumnRenamed("rank", "r"), "node"), "lists-by-place")
    for low, high in windows(places):
        left = places.join(gone, "node", "left_anti")
        met = met_within(left, places, low, high)
        met = met.filter((F.col("r_y") < F.col("r")) & could(F.col("n"), F.col("v"), F.col("n_y"), F.col("v_y")))
        rest = materialise(met.select(F.col("node_y").alias("x"), F.col("node").alias("y")).distinct(), "line-pairs")
        if rest.limit(1).count():
            more = similar(rest, full).select(F.col("y").alias("node"))
            gone = materialise(gone.unionByName(more).distinct(), "alike-lines")
    # Of equal sets all but the first go, and the first too when it is alike an earlier line.
    equal = held.join(first.select("node", F.col("place").alias("f")), "node").filter(F.col("place") != F.col("f")).select("place")
    alike = first.join(gone, "node", "left_semi").select("place")
    return equal.unionByName(alike).select("place.*").distinct()


def dedup(docs: DataFrame, removed: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the repeated lines cut out of the texts; no row goes.

    Other columns stay as they are. ``removed`` names a column to add: how many lines went.
    """
    each = repeated(docs, frequent).groupBy("doc_id", "copy").agg(F.collect_set("line_no").alias("gone"))
    each = materialise(each.select(F.struct("doc_id", "copy", "gone").alias("cut")), "cut-lines")
    # The whole row is one column, so no name of it can clash.
    row = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("cut.doc_id")) & (F.xxhash64("row.text") == F.col("cut.copy"))
    joined = row.join(each, same, "left")
    rest = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("cut.gone", i))
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(F.array_join(rest, "\n"))
    count = [F.coalesce(F.size("cut.gone"), F.lit(0)).cast("bigint").alias(removed)] if removed else []
    others = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != removed]
    return joined.select(*others, *count)
