"""Tokenizer and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import standins as s
from catalog.grammar_sql import u32 as sql_u32
from catalog.registry import query, table
from glyphmill.functions.draws import listed, u32
from glyphmill.operators import bpe, metrics, sequences as seq, splits
from glyphmill.plans.vocabulary import MAX_LEN
from glyphmill.session import materialise, new_path, spread


def trained(spark, sf):
    """Tokenizer of the documents at its full size."""
    return bpe.train(bpe.pretoken_counts(texts(spark, sf), "text"))


def texts(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


# RE2 has no look-ahead: a mark before the last blank of a run that meets a word does its work.
BLANK = r"\s\x0b\x{85}\p{Z}"
LINES_SQL = "(SELECT unnest(string_split(text, chr(10))) || chr(10) AS line FROM documents)"
MARKED_SQL = rf"regexp_replace(line, '([{BLANK}][^{BLANK}])', chr(1) || '\1', 'g')"
PIECE_RE = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}\x01]+|[{BLANK}]+"


@query("tok_pretoken_counts", f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all({MARKED_SQL}, '{PIECE_RE}')) AS piece FROM {LINES_SQL}) GROUP BY 1")
def tok_pretoken_counts(spark, sf):
    return bpe.pretoken_counts(texts(spark, sf), "text")


@query("tok_word_counts", """
    SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS word FROM documents) GROUP BY 1""")
def tok_word_counts(spark, sf):
    words = F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), F.lit(0))
    return texts(spark, sf).select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("tok_train_bpe")
def tok_train_bpe(spark, sf):
    return bpe.merge_table(spark, trained(spark, sf))


@query("tok_encode", "SELECT doc_id, octet_length(encode(text)) AS bytes, text FROM documents")
def tok_encode(spark, sf):
    """The tokens' bytes add up to the text's, and the ids spell the text."""
    model = trained(spark, sf)
    widths = listed([len(t) for t in model.tokens])
    coded = texts(spark, sf).select("doc_id", bpe.encode(F.col("text"), model).alias("ids"))
    bytes_ = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, i: a + F.get(widths, i))
    return coded.select("doc_id", bytes_.alias("bytes"), bpe.decode(F.col("ids"), model).alias("text"))


@query("tok_decode", "SELECT doc_id, text FROM documents")
def tok_decode(spark, sf):
    model = trained(spark, sf)
    coded = texts(spark, sf).select("doc_id", bpe.encode(F.col("text"), model).alias("ids"))
    return coded.select("doc_id", bpe.decode(F.col("ids"), model).alias("text"))


@query("tok_roundtrip", "SELECT count(*) AS rows, 0::BIGINT AS failures FROM documents")
def tok_roundtrip(spark, sf):
    return bpe.roundtrip_check(texts(spark, sf), "text", trained(spark, sf))


@query("agg_corpus_tokens")
def agg_corpus_tokens(spark, sf):
    """Characters a token, by the tokens of the trained tokenizer over all rows."""
    model = trained(spark, sf)
    coded = texts(spark, sf).select(F.length("text").alias("chars"), F.size(bpe.encode(F.col("text"), model)).alias("tokens"))
    sums = coded.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("chars", "tokens")])
    return sums.withColumn("chars_per_token", F.col("chars") / F.greatest("tokens", F.lit(1)))


@query("tok_save_load")
def tok_save_load(spark, sf):
    path = new_path(spark, "tokenizer")
    bpe.save(spark, trained(spark, sf), path)
    return bpe.vocab_table(spark, bpe.load(spark, path))


# --- words to ids through a vocabulary table -----------------------------------------


@query("join_token_ids", """
    WITH v AS (SELECT word, dense_rank() OVER (ORDER BY n DESC, word) + 3 AS id FROM
        (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1) QUALIFY dense_rank() OVER (ORDER BY n DESC, word) <= 5996)
    SELECT doc_id, pos, coalesce(id, 3)::INTEGER AS id FROM
      (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' '))))::INTEGER AS pos FROM documents) LEFT JOIN v USING (word)""")
def join_token_ids(spark, sf):
    """The vocabulary is the 5996 most frequent words. It is written first, so that its
    measured size decides whether it is broadcast."""
    words = texts(spark, sf).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(5996)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("ws"))
    vocab = materialise(ranked.select(F.posexplode("ws").alias("i", "w")).select("w.word", (F.col("i") + 4).alias("id")), "vocab")
    return words.join(vocab, "word", "left").select("doc_id", "pos", F.coalesce("id", F.lit(3)).alias("id"))


VOCABULARY_SQL = """(SELECT word, (row_number() OVER (ORDER BY n DESC, word) + 3)::INTEGER AS id FROM
      (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, word) <= 5996)"""
PLACED_SQL = "(SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS pos FROM documents)"


@query("join_ids_to_tokens", f"""
    SELECT doc_id, string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE word END, ' ' ORDER BY pos) AS text, count(*) FILTER (WHERE id IS NULL) AS unknown, sum(coalesce(id, 3))::BIGINT AS ids
    FROM {PLACED_SQL} LEFT JOIN {VOCABULARY_SQL} USING (word) GROUP BY 1""")
def join_ids_to_tokens(spark, sf):
    """Words to ids through a ranked vocabulary, and the ids back to text."""
    words = texts(spark, sf).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    vocabulary = seq.ranked_vocabulary(words, "word", 5996, 4)
    ids = seq.words_to_ids(words, "word", vocabulary, 3)
    back = seq.ids_to_text(ids, "doc_id", "pos", vocabulary, "word", "<unk>")
    sums = ids.groupBy("doc_id").agg(F.count_if(F.col("id") == 3).alias("unknown"), F.sum(F.col("id").cast("bigint")).alias("ids"))
    return back.join(sums, "doc_id")


# --- sequences ------------------------------------------------------------------------

IDS = s.TOKEN_IDS_SQL
SEQ = f"(SELECT doc_id, [1] || ids || [2] AS ids FROM {IDS})"
CUT = f"(SELECT doc_id, [1] || list_slice(ids, 1, 638) || [2] AS ids FROM {IDS})"
PADDED = f"""(SELECT doc_id, batch_id, ids || list_resize([]::INTEGER[], longest - len(ids), 0) AS ids FROM
   (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM {SEQ})))"""


def framed(spark, sf):
    ids = s.token_ids(spark, sf)
    return ids.select("doc_id", seq.to_sequence(F.col("ids"), None).alias("ids"))


def padded(spark, sf):
    return seq.pad_batches(splits.with_batches(framed(spark, sf), "doc_id", 16), "ids")


def shown(ids):
    return F.array_join(ids.cast("array<string>"), " ")


@query("seq_frame", f"SELECT doc_id, array_to_string(ids, ' ') AS ids FROM {CUT}")
def seq_frame(spark, sf):
    """Framing to the model's length; what does not fit is the truncation report's."""
    ids = seq.to_sequence(F.col("ids"), MAX_LEN)
    return s.token_ids(spark, sf).select("doc_id", shown(ids).alias("ids"))


@query("seq_pad_batch", f"SELECT doc_id, batch_id, array_to_string(ids, ' ') AS ids FROM {PADDED}")
def seq_pad_batch(spark, sf):
    return padded(spark, sf).select("doc_id", "batch_id", shown(F.col("ids")).alias("ids"))


@query("seq_padded_batches", f"SELECT doc_id, batch_id, array_to_string(ids, ' ') AS ids FROM {PADDED}")
def seq_padded_batches(spark, sf):
    """Batches and padding with one shuffle of the sequences."""
    return seq.padded_batches(framed(spark, sf), "doc_id", "ids", 16).select("doc_id", "batch_id", shown(F.col("ids")).alias("ids"))


@query("seq_shift_pair", f"SELECT doc_id, array_to_string(ids[:-2], ' ') AS inputs, array_to_string(ids[2:], ' ') AS labels FROM {SEQ}")
def seq_shift_pair(spark, sf):
    inputs, labels = seq.shift_pair(F.col("ids"))
    return framed(spark, sf).select("doc_id", shown(inputs).alias("inputs"), shown(labels).alias("labels"))


@query("seq_pad_mask", f"SELECT doc_id, array_to_string(list_transform(ids, lambda x: (x <> 0)::INTEGER), '') AS mask FROM {PADDED}")
def seq_pad_mask(spark, sf):
    mask = F.transform(seq.pad_mask(F.col("ids")), lambda b: b.cast("int").cast("string"))
    return padded(spark, sf).select("doc_id", F.array_join(mask, "").alias("mask"))


NOISY_EOS = f"(SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x % 397 = 0 THEN 2 ELSE x END) AS ids FROM {IDS})"


@query("seq_cut_at_eos", f"""
    SELECT doc_id, array_to_string(CASE WHEN p > 0 THEN list_slice(k, 1, p) || list_resize([]::INTEGER[], len(k) - p, 2) ELSE k END, ' ') AS ids
    FROM (SELECT doc_id, k, coalesce(list_position(k, 2), 0) AS p FROM (SELECT doc_id, ids AS k FROM {NOISY_EOS}))""")
def seq_cut_at_eos(spark, sf):
    drawn = s.token_ids(spark, sf).withColumn("ids", F.transform("ids", lambda x: F.when(x % 397 == 0, 2).otherwise(x)))
    return drawn.select("doc_id", shown(seq.cut_at_eos(F.col("ids"), None)).alias("ids"))


@query("seq_without_special", f"SELECT doc_id, array_to_string(list_filter(ids, lambda x: x NOT IN (0, 1, 2)), ' ') AS ids FROM {PADDED}")
def seq_without_special(spark, sf):
    return padded(spark, sf).select("doc_id", shown(seq.without_special(F.col("ids"))).alias("ids"))


@query("seq_truncation_report", f"""
    SELECT count(*) AS rows, count(*) FILTER (WHERE len(ids) > 638) AS rows_cut, sum(greatest(len(ids) - 638, 0))::BIGINT AS tokens_lost, max(len(ids))::INTEGER AS longest FROM {IDS}""")
def seq_truncation_report(spark, sf):
    return seq.truncation_report(s.token_ids(spark, sf), "ids", MAX_LEN)


GUESSED = f"""(SELECT doc_id, doc_id % 7 AS epoch, ids[2:] AS labels, list_transform(ids[2:], lambda x, i: CASE WHEN {sql_u32("'hit'", 'doc_id', 'i - 1')} % 10 = 0 THEN x + 1 ELSE x END) AS preds FROM {SEQ})"""


def guessed(spark, sf):
    """Accuracy leaves padding out, so nothing is padded for it."""
    _, labels = seq.shift_pair(F.col("ids"))
    rows = framed(spark, sf).select("doc_id", (F.col("doc_id") % 7).alias("epoch"), labels.alias("labels"))
    return rows.withColumn("preds", F.transform("labels", lambda x, i: F.when(u32("hit", F.col("doc_id"), i) % 10 == 0, x + 1).otherwise(x)))


CORRECT_SQL = "len(list_filter(list_zip(preds, labels), lambda z: z[1] = z[2] AND z[2] <> 0))"


@query("agg_token_accuracy", f"""
    SELECT sum({CORRECT_SQL})::BIGINT AS correct, sum(len(list_filter(labels, lambda x: x <> 0)))::BIGINT AS total,
      sum({CORRECT_SQL}) / greatest(sum(len(list_filter(labels, lambda x: x <> 0))), 1) AS token_accuracy FROM {GUESSED}""")
def agg_token_accuracy(spark, sf):
    return metrics.token_accuracy(guessed(spark, sf), "preds", "labels")


@query("eval_epoch_accuracy", f"""
    SELECT epoch, sum({CORRECT_SQL})::BIGINT AS correct, sum(len(list_filter(labels, lambda x: x <> 0)))::BIGINT AS total,
      sum({CORRECT_SQL}) / greatest(sum(len(list_filter(labels, lambda x: x <> 0))), 1) AS token_accuracy FROM {GUESSED} GROUP BY 1""")
def eval_epoch_accuracy(spark, sf):
    return metrics.token_accuracy(guessed(spark, sf), "preds", "labels", ["epoch"])
