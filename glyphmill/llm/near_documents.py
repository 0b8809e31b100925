"""Operator 3: documents linked by the Jaccard similarity of their n-grams.

A document's set holds its distinct five-word shingles, A-Z in lower case; a
document of fewer words has the whole sequence as its one shingle, one without
words has none and is linked with nothing. Two documents are linked when their
sets share at least 0.8 of their union, and a component is what links reach.

Equal sets are one node, by a 64-bit hash, so exact copies cost one row each and
no pair. Nodes meet by token combinations (see ``setjoin``): rare shingles of the
extended prefixes index them alone, and nodes without enough rare shingles, which
lie in crowds of near copies, meet by combinations of shingles. A sketch, one bit
per shingle and parity, bounds from below in how many shingles two sets differ and
drops most pairs that merely share a passage; the rest is verified by all shingles.

Links are looked for as far as components need them. Each node is compared with
the smallest of its candidates first, each member of a crowd with the smallest of
its list, and only pairs that these links leave in different components are
verified after that. No link between different components is lost.

Null texts count as empty. Rows of one doc_id with the same set are one node;
otherwise a doc_id that occurs several times has a row per row, each with its own
component. A null doc_id never names a component unless nothing else is in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import components, sliced
from glyphmill.llm.hashing import mix, shingle_set
from glyphmill.llm.setjoin import FREQUENT, SHARE, candidates, could, led, met_within, placed, similar, windows
from glyphmill.session import materialise

LEAST_BITS = 64
#: Members of a crowd's list that all others are compared with first; copies of one text can each lie too far
#: from one of them and near enough to another.
LEADERS = 3


def reserve(n: int) -> int:
    """As ``setjoin.reserve_length``, for one size."""
    prefix = n - (n * SHARE + 99) // 100 + 1 if n else 0
    return min(n, int(prefix * 1.25) + 2)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A bit per slot, set when an odd number of tokens fall on it; as many slots as the next power of two."""
    slots = max(LEAST_BITS, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sets(docs: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, node, n, tokens, sketch) per row of ``docs``; ``tokens`` are all of them or the reserve, ascending."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lists(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    def run(batches):
        salt = np.uint64(0x8EBC6AF09C88C6E3)
        for batch in sliced(batches):
            nodes, sizes, tokens, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set((text or "").encode())
                signed = np.sort(found.view(np.int64))
                place = mix(found * salt + np.uint64(1))
                nodes.append(int(mix(np.array([place.sum(dtype=np.uint64) + np.uint64(len(found))])).view(np.int64)[0]))
                sizes.append(len(found))
                tokens.append(signed if whole else signed[: reserve(len(found))])
                bits.append(sketch(place))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists(tokens), lists(bits)],
                names=["doc_id", "node", "n", "tokens", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, n int, tokens array<long>, sketch array<long>")


def close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sketches allow them to be similar.

    Two similar sets differ in at most a ninth of their sizes' sum, and every slot
    that differs takes a token that does. The larger sketch is folded to the smaller.
    """
    ends = pairs
    for side in "xy":
        named = nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
        ends = ends.join(named, side)

    def folded(a, b):
        half = (F.size(a) / 2).cast("int")
        once = F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(a) > F.size(b), once).otherwise(a)

    x, y = folded(F.col("sx"), F.col("sy")), folded(F.col("sy"), F.col("sx"))
    odd = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    return ends.filter((100 + SHARE) * odd <= (100 - SHARE) * (F.col("nx") + F.col("ny"))).select("x", "y")


def linked(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    docs = docs.select("doc_id", "text")
    rows = materialise(sets(docs, False), "shingle-sets")
    held = rows.filter("n > 0")
    ids = materialise(held.groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch")), "nodes")

    def full(nodes: DataFrame) -> DataFrame:
        """All shingles of some nodes, from one document of each."""
        wanted = materialise(ids.join(nodes, "node", "left_semi").select(F.col("doc_id").alias("_id")).distinct(), "wanted-documents")
        some = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]), "left_semi")
        found = sets(some, True).join(nodes, "node", "left_semi")
        return found.dropDuplicates(["node"]).select("node", "n", "tokens")

    pairs, lists = candidates(held, full, frequent)
    for salt in range(LEADERS if lists.limit(1).count() else 0):
        stars = led(lists, ids.select("node", F.xxhash64("node", F.lit(salt)).alias("rank")))
        pairs = pairs.unionByName(stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    some = materialise(close(pairs.distinct(), ids), "close-pairs")
    # First one partner for each node, from either side.
    one = some.groupBy("y").agg(F.min("x").alias("x")).select("x", "y").unionByName(some.groupBy("x").agg(F.max("y").alias("y"))).distinct()
    links = materialise(similar(one, full), "links")
    roots = components(links)
    apart = materialise(different(some, roots).join(one, ["x", "y"], "left_anti"), "pairs-apart")
    if apart.limit(1).count():
        links = links.unionByName(materialise(similar(apart, full), "links"))
        roots = components(links)
    places = placed(mixed(lists, roots))
    for low, high in windows(places):
        apart = materialise(close(across(places, roots, low, high), ids), "pairs-apart")
        if apart.limit(1).count():
            links = links.unionByName(materialise(similar(apart, full), "links"))
            roots = components(links)
    smallest = ids.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("doc_id").alias("component_id"))
    named = ids.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")).join(smallest, "root")
    named = materialise(named.select(F.col("node").alias("_node"), F.col("n").alias("_n"), "component_id"), "named-nodes")
    out = rows.select("doc_id", "node", "n").join(named, (F.col("node") == F.col("_node")) & (F.col("n") == F.col("_n")), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"), "node")


def root_of(frame: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias(column), F.col("root").alias(f"root_{column}"))
    return frame.join(named, column, "left").withColumn(f"root_{column}", F.coalesce(f"root_{column}", column))


def different(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    both = root_of(root_of(pairs, "x", roots), "y", roots)
    return both.filter(F.col("root_x") != F.col("root_y")).select("x", "y")


def mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members are in several components."""
    named = root_of(lists.select("key", F.col("node").alias("x")), "x", roots)
    apart = named.groupBy("key").agg(F.min("root_x").alias("low"), F.max("root_x").alias("high")).filter("low != high").select("key")
    return lists.join(apart, "key", "left_semi")


def across(places: DataFrame, roots: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs x < y of a list's members in different components, ``low`` to ``high`` - 1 places apart.

    Of each list the largest component's members ask nobody: whom they should meet is in another one and asks them.
    """
    named = materialise(root_of(places.withColumnRenamed("node", "x"), "x", roots).withColumnRenamed("root_x", "root"), "lists-by-root")
    largest = named.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("l"))
    asking = named.join(largest.select("key", F.col("l.root").alias("_largest")), "key").filter(F.col("root") != F.col("_largest")).drop("_largest")
    met = met_within(asking, named, low, high).filter((F.col("root") != F.col("root_y")) & could(F.col("n"), F.col("v"), F.col("n_y"), F.col("v_y")))
    return met.select(F.least("x", "x_y").alias("x"), F.greatest("x", "x_y").alias("y")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id.

    Rows without words or without a doc_id all stay; rows of one doc_id stay or go together.
    """
    rows = linked(docs)
    keys = rows.select("doc_id", "n_shingles", "component_id")
    gone = keys.filter((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    gone = materialise(gone, "near-copies")
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
