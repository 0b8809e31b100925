"""Label repair: put the texts read from a picture into the quoted labels, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.draws import let
from glyphmill.functions.text import labels_of
from glyphmill.operators.running import ROWS_PER_BUCKET, meet, with_rank

ROW_HEIGHT = 20  # fixed value: boxes whose tops round to the same row are read left to right


def corner(box: Column) -> tuple[Column, Column]:
    """Smallest x and y of a four-point box."""
    return F.array_min(F.transform(box, lambda p: p["x"])), F.array_min(F.transform(box, lambda p: p["y"]))


def reading_order(items: Column) -> Column:
    """Texts of the boxes, top to bottom, then left to right; halves round to even."""

    def keyed(item: Column, pos: Column) -> Column:
        x, y = corner(item["box"])
        return F.struct(F.bround(y / ROW_HEIGHT).alias("row"), x.alias("x"), pos.alias("pos"), item["text"].alias("text"))

    return F.sort_array(F.transform(items, keyed))["text"]


def substitute(code: Column, texts: Column) -> Column:
    """The k-th quoted label takes the k-th text; labels beyond the texts stay."""

    def rebuilt(labels: Column, new: Column) -> Column:
        between = F.split(code, '"[^"]*"', -1)
        slots = F.transform(labels, lambda old, i: F.concat(F.lit('"'), F.coalesce(F.get(new, i), old), F.lit('"')))
        return F.array_join(F.zip_with(between, slots, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(texts, lambda new: let(labels_of(code), lambda labels: rebuilt(labels, new)))


def substitutions(code: Column, texts: Column) -> Column:
    """What became of each label: kept, unchanged or replaced."""

    def entry(read: Column, old: Column, i: Column) -> Column:
        new = F.get(read, i)
        status = F.when(new.isNull(), "kept").when(new == old, "unchanged").otherwise("replaced")
        return F.struct(i.alias("pos"), old.alias("original"), new.alias("replacement"), status.alias("status"))

    return let(texts, lambda read: F.transform(labels_of(code), lambda old, i: entry(read, old, i)))


def positional_join(left: DataFrame, right: DataFrame, key: str, pos: str) -> DataFrame:
    """The k-th left row with the k-th right row; surplus on the right is dropped."""
    return left.join(right, [key, pos], "left")


def kth_with_kth(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The k-th left row of a group with the k-th right row, each side in its own order; callers bring no positions.

    Left rows stay where the right side runs out; a surplus on the right is dropped. Both orders are total and
    begin with a number; groups are ranked in buckets, so a large one is spread. Adds ``pos`` from 1 on.
    """
    a = with_rank(left, by, left_order, "pos", rows_per_bucket)
    b = with_rank(right, by, right_order, "pos", rows_per_bucket)
    return meet(a, b.select(*by, "pos", *[c for c in right.columns if c not in left.columns]), [*by, "pos"], "left")
