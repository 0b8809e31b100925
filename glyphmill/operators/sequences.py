"""Token sequences: framing, padding, masking, cutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.running import ROWS_PER_BUCKET, with_rank
from glyphmill.plans.vocabulary import BOS, EOS, PAD
from glyphmill.session import materialise


def ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def to_sequence(ids: Column, max_len: int | None) -> Column:
    """BOS, as many ids as fit into ``max_len`` or all of them, EOS."""
    return F.concat(ints(BOS), ids if max_len is None else F.slice(ids, 1, max_len - 2), ints(EOS))


def pad_batches(df: DataFrame, ids: str, batch: str = "batch_id") -> DataFrame:
    """Right-pad to the longest sequence of the batch. A batch is a fixed number of rows."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn("_longest", longest).withColumn(
        ids, F.concat(F.col(ids), F.array_repeat(F.lit(PAD), F.col("_longest") - F.size(ids)))
    ).drop("_longest")


def padded_batches(df: DataFrame, order: str, ids: str, size: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Batches of ``size`` rows in order of a unique key, padded to the longest sequence of each.

    Keys and lengths alone are ranked, batched and compared; the sequences move once, to meet their batch and its
    length on the key.
    """
    slim = df.select(order, F.size(ids).alias("_n"))
    ranked = with_rank(slim, [], [order], "_place", rows_per_bucket).withColumn("batch_id", F.expr(f"(_place - 1) div {size}"))
    longest = F.max("_n").over(Window.partitionBy("batch_id")).alias("_longest")
    known = ranked.select(order, "batch_id", longest).repartition(F.col(order))
    met = df.join(known, order)
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(PAD), F.col("_longest") - F.size(ids)))
    return met.withColumn(ids, padded).select(*df.columns, "batch_id")


def shift_pair(ids: Column) -> tuple[Column, Column]:
    """Model input (all but the last id) and labels (all but the first)."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def pad_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: x != PAD)


def cut_at_eos(ids: Column, most: int | None) -> Column:
    """Ids up to the first EOS, then EOS to the end; at most ``most`` ids unless it is None."""
    kept = ids if most is None else F.slice(ids, 1, most)
    at = F.array_position(kept, EOS).cast("int")
    filled = F.concat(F.slice(kept, F.lit(1), at), F.array_repeat(F.lit(EOS), F.size(kept) - at))
    return F.when(at > 0, filled).otherwise(kept)


def without_special(ids: Column) -> Column:
    """Drop framing and padding ids; order and duplicates stay."""
    return F.filter(ids, lambda x: ~x.isin(PAD, BOS, EOS))


def truncation_report(df: DataFrame, ids: str, max_len: int) -> DataFrame:
    over = F.size(ids) - (max_len - 2)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(over > 0).alias("rows_cut"),
        F.coalesce(F.sum(F.greatest(over, F.lit(0))), F.lit(0)).cast("bigint").alias("tokens_lost"),
        F.coalesce(F.max(F.size(ids)), F.lit(0)).alias("longest"),
    )


def ranked_vocabulary(words: DataFrame, word: str, size: int, first_id: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(word, id): the ``size`` most frequent words, ids from ``first_id`` on by frequency and then by word."""
    counts = words.groupBy(word).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.where(F.col(word).isNotNull()).orderBy(F.desc("_n"), word).limit(size).withColumn("_n", -F.col("_n"))
    ranked = with_rank(top, [], ["_n", word], "_place", rows_per_bucket)
    return materialise(ranked.select(word, (F.col("_place") + first_id - 1).cast("int").alias("id")), "vocabulary")


def words_to_ids(words: DataFrame, word: str, vocabulary: DataFrame, unknown: int) -> DataFrame:
    """Add ``id``; Catalyst sends the vocabulary to all tasks if it is small enough."""
    return words.join(vocabulary, word, "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def ids_to_text(ids: DataFrame, by: str, pos: str, vocabulary: DataFrame, word: str, unknown: str) -> DataFrame:
    """(by, text): the words of the ids in order of their place, a blank between."""
    named = ids.select(by, pos, "id").join(vocabulary, "id", "left").withColumn(word, F.coalesce(word, F.lit(unknown)))
    return named.groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(F.struct(pos, word)))[word], " ").alias("text"))


#: Cells that pairs are counted in by their hash, and the fullest of them, which tell how often a listed pair occurs at least.
CELLS, FULLEST = 1 << 20, 1000


def top_pairs(df: DataFrame, words: str, most: int) -> DataFrame:
    """The ``most`` most frequent pairs of neighbours (a, b, n), ties by a and b.

    Only pairs that may be listed are counted one by one. A first pass counts cells of pairs, a bounded table
    whatever the vocabulary. The pairs in the fullest cells say how often the last listed one occurs at least;
    a pair in a cell that counts less cannot be listed.
    """
    n = F.greatest(F.size(words) - 1, F.lit(0))
    both = F.arrays_zip(F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b"))
    pairs = df.select(F.inline(both)).withColumn("cell", F.xxhash64("a", "b").bitwiseAND(F.lit(CELLS - 1)))

    def counted(some: DataFrame) -> DataFrame:
        return some.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))

    cells = materialise(pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    fullest = materialise(cells.orderBy(F.desc("n"), "cell").limit(FULLEST).select("cell"), "fullest")
    found = counted(pairs.join(fullest, "cell", "left_semi")).orderBy(F.desc("n")).limit(most).collect()
    least = found[-1].n if len(found) == most else 1
    # Cells have a pair at least: a bound of one leaves nothing out.
    likely = pairs if least <= 1 else pairs.join(materialise(cells.where(F.col("n") >= least).select("cell"), "likely"), "cell", "left_semi")
    return counted(likely).orderBy(F.desc("n"), "a", "b").limit(most)
