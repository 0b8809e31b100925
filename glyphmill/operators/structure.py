"""Node and edge precision, recall and F1 of flowchart texts; identifiers and brackets do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.draws import let

#: A node line: identifier, any brackets, the label in them. An edge line: identifiers about an arrow, perhaps with a label.
NODE = r'(?m)^\s*([A-Za-z]\w*)[\[({]+"?([^"\[\](){}\n]*)"?[\])}]+\s*$'
EDGE = r"(?m)^\s*([A-Za-z]\w*)\s*(?:-->|---|-\.->|==>)(?:\|([^|\n]*)\|)?\s*([A-Za-z]\w*)\s*$"
FLOW = r"^\s*(flowchart|graph)\b"


def parts(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def nodes(text: Column) -> Column:
    """The labels of the nodes, in order."""
    return parts(text, NODE, 2)


def edges(text: Column) -> Column:
    """``from|label|to`` of the edges, labels in place of identifiers that have one."""

    def named(known: Column, x: Column) -> Column:
        return F.coalesce(F.get(known["labels"], F.nullif(F.array_position(known["ids"], x), F.lit(0)).cast("int") - 1), x)

    ends = F.arrays_zip(parts(text, EDGE, 1).alias("a"), parts(text, EDGE, 2).alias("l"), parts(text, EDGE, 3).alias("b"))
    found = F.struct(parts(text, NODE, 1).alias("ids"), nodes(text).alias("labels"))
    return let(found, lambda known: F.transform(ends, lambda e: F.concat_ws("|", named(known, e["a"]), e["l"], named(known, e["b"]))))


def shared(a: Column, b: Column) -> Column:
    """Items that two lists share, each as often as in the list that has it less often."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    total = lambda p: F.aggregate(F.array_distinct(p["a"]), F.lit(0), lambda n, x: n + F.least(times(p["a"], x), times(p["b"], x)))
    return let(F.struct(a.alias("a"), b.alias("b")), total)


def with_structure(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Add counts of nodes and edges, true, predicted and shared; null where the truth is no flowchart."""
    flow = F.col(truth).rlike(FLOW)

    def counts(kind: str, a: Column, b: Column) -> Column:
        both = F.struct(a.alias("a"), b.alias("b"))
        return let(both, lambda p: F.struct(
            F.size(p["a"]).alias(f"{kind}s_true"), F.size(p["b"]).alias(f"{kind}s_predicted"), shared(p["a"], p["b"]).alias(f"{kind}s_shared")
        ))

    # Each list is worked out once per text; a lambda that named it anew would read the text once per item.
    made = {kind: F.when(flow, counts(kind, found(F.col(truth)), found(F.col(prediction)))) for kind, found in (("node", nodes), ("edge", edges))}
    # An exploded one-element array cannot be folded back into its uses as a struct column can.
    held = df.withColumn("_parts", F.explode(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))
    fields = {f"{k}s_{x}": F.col("_parts")[k][f"{k}s_{x}"] for k in made for x in ("true", "predicted", "shared")}
    return held.withColumns(fields).drop("_parts")


def rates(kind: str, of=F.col) -> dict[str, Column]:
    """Precision, recall and F1 of ``node`` or ``edge`` counts; 0 where nothing is there to share."""
    hit, true, made = (of(f"{kind}s_{x}") for x in ("shared", "true", "predicted"))
    share = lambda n: F.coalesce(hit / F.nullif(n, F.lit(0)), F.when(hit.isNotNull(), 0.0))
    both = F.coalesce(2 * hit / F.nullif(true + made, F.lit(0)), F.when(hit.isNotNull(), 0.0))
    return {f"{kind}_precision": share(made), f"{kind}_recall": share(true), f"{kind}_f1": both}


def structure_f1(df: DataFrame, by: str) -> DataFrame:
    """Per class: flowcharts, micro F1 over all their parts and macro F1 over texts; null for classes without flowcharts."""
    each = df.withColumns(rates("node") | rates("edge"))
    micro = {k: rates(k, lambda c: F.sum(c))[f"{k}_f1"].alias(f"{k}_micro_f1") for k in ("node", "edge")}
    macro = {k: F.round(F.avg(f"{k}_f1"), 9).alias(f"{k}_macro_f1") for k in ("node", "edge")}
    return each.groupBy(by).agg(F.count("nodes_true").alias("flowcharts"), *micro.values(), *macro.values())
