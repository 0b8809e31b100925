"""The registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table


# --- SQL that states results -----------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles_sql(key: str, text: str, source: str) -> str:
    """Distinct (key, sh): five-word shingles of a text, all its words where it has fewer; no rows without words."""
    words = rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh
      FROM (SELECT {key}, {words} AS ws FROM {source}) WHERE len(ws) > 0"""


NGRAM_SQL = f"""
    WITH RECURSIVE s AS ({shingles_sql('doc_id', f"translate(text, '{UPPER}', '{LOWER}')", 'documents')}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
    reach(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = o)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
      JOIN (SELECT doc_id, min(o) AS component_id FROM reach GROUP BY 1) m USING (doc_id)"""

LINES_SQL = "(SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
LINE_SQL = f"""
    WITH l AS (SELECT doc_id * 100000 + line_no AS id, doc_id, line_no, line FROM {LINES_SQL}),
    s AS ({shingles_sql('id', 'line', 'l')}), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
    shared AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.id < b.id GROUP BY 1, 2),
    gone AS (SELECT DISTINCT y AS id FROM shared JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * c >= 80 * (a.n + b.n - c))
    SELECT doc_id, count(gone.id) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE gone.id IS NULL), '')) AS text_sha256
    FROM l LEFT JOIN gone USING (id) GROUP BY 1"""


def secret_sql() -> str:
    """The same parts by another road: places from match lengths, scopes by comparing all parts of a document."""
    from glyphmill.llm.secrets import BASE, KINDS, REACH

    parts = []
    for place, (kind, (role, strong, pattern, group, least)) in enumerate(KINDS.items()):
        # RE2 cannot look around: a key is a whole run of its class and of the characters that may not stand beside it.
        run, fits = (r"[A-Za-z0-9+/=_-]+", "length(m) = 40 AND NOT regexp_matches(m, '[=_-]')") if kind == "key40" else (pattern, f"length(part) >= {least}")
        run = run.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, '{role}' AS role, {strong} AS strong, s, s + length(m) AS e FROM (
          SELECT doc_id, ms[i] AS m, ps[i] AS part, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{run}', 0) AS ms, regexp_extract_all(text, '{run}', {group if kind != 'key40' else 0}) AS ps,
            string_split_regex(text, '{run}') AS gs FROM documents))) WHERE {fits}""")
    told = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, place)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
    WITH p AS ({' UNION ALL '.join(parts)}),
    k AS (SELECT * FROM p WHERE strong OR EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.role <> p.role AND o.s <= p.e + {REACH} AND p.s <= o.e + {REACH}))
    SELECT doc_id, {counts}, sha256(coalesce({told} FILTER (WHERE strong), '')) AS base_sha256, coalesce({told}, '') AS spans
    FROM documents LEFT JOIN k USING (doc_id) GROUP BY 1"""


# --- queries ----------------------------------------------------------------------------


def tokenizer_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.pieces import encode_decode, ids_text

    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = encode_decode(docs, tokenizer_model())
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_secrets", secret_sql())
def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.secrets import BASE, secrets, told

    out = secrets(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["strong"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return out.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.quality_rules import fit, judged, with_measures, with_votes
    from glyphmill.session import materialise

    docs = table(spark, sf, "documents").select("doc_id", "text")
    measured = materialise(with_measures(docs).drop("text"), "quality-measures")
    out = judged(measured, fit(with_votes(measured)))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@query("op1_style_tree")
def op1_style_tree(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.style_tree import main_text

    out = main_text(table(spark, sf, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.toxicity import toxicity

    out = toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.decontaminate import leaks

    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("key")


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.pii import KINDS, personal, train
    from glyphmill.llm.secrets import told

    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = personal(docs, train(docs))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@query("op5_site_quality")
def op5_site_quality(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.site_quality import quality

    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    out = quality(docs, table(spark, sf, "labels"))
    return out.select("doc_id", "held_out", "evidence", "host_posterior", "path_posterior", "score", "kept")


@query("op3_ngram_join", NGRAM_SQL)
def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.near_documents import linked

    return linked(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_line_dedup", LINE_SQL)
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.lines import dedup

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup(docs, "n_removed").select("doc_id", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def phrase_sql(least: int = 10, top: int = 2000, absorbed: int = 50) -> str:
    """The same collocations from the words of every piece, grouped by their text."""
    pieces = rf"unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\n\x0B-\x0D]'))"
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase FROM ws WHERE len(w) >= {n}" for n in (1, 2, 3)
    )
    return f"""
    WITH ps AS (SELECT coalesce(lang, 'und') AS lang, {pieces} AS piece FROM documents),
    ws AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM ps),
    f AS MATERIALIZED (SELECT lang, n, phrase, count(*)::HUGEINT AS a FROM ({grams}) GROUP BY ALL),
    total AS (SELECT lang, sum(len(w)) AS total FROM ws GROUP BY 1),
    g AS MATERIALIZED (SELECT lang, phrase, a FROM f WHERE a >= {least}),
    c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND a >= {least}),
    parts AS MATERIALIZED (SELECT lang, phrase, n, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, n)) AS k FROM c)),
    cuts AS (SELECT p.lang, p.phrase, p.n, p.a, k, l.a AS l, r.a AS r, (1000000 * p.a * p.a) // (l.a * r.a) AS score
      FROM parts p JOIN g l ON l.lang = p.lang AND l.phrase = p.lp JOIN g r ON r.lang = p.lang AND r.phrase = p.rp),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
    around AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE n = 3) GROUP BY 1, 2),
    ranked AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
      FROM best LEFT JOIN around ON around.lang = best.lang AND around.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < {absorbed} * a)
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total::BIGINT AS n, score::BIGINT AS score
    FROM ranked JOIN total USING (lang) WHERE rank <= {top}"""


@query("op11_phrase_collocations", phrase_sql())
def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.collocations import collocations

    return collocations(table(spark, sf, "documents"))


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from glyphmill.llm.token_counts import token_counts

    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def repair_sql() -> str:
    """The damage, the faults, and the cheapest edits by a recursion over the rows of each conversation from its end.

    A row of ``best`` holds cost, audit and repaired rows by state: start, behind s, behind u, behind a.
    """
    turn = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "xor(c, ascii(x)::BIGINT)"
    for _ in range(8):
        byte = f"(list_transform([{byte}], lambda c: {turn})[1])"
    # A list of one keeps the running value; SQL has no fold from a start value here.
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {byte.replace('ascii(x)::BIGINT', 'b')}), 4294967295)"
    ahead, wanted, lead = (3, 3, 4, 3), ("u", "u", "a", "u"), ({"s": 2, "u": 3}, {"u": 3}, {"a": 4}, {"u": 3})
    role = {"u": "user", "a": "assistant"}

    def then(q: int, cost: str, letter: str, told: str | None, rest: str = "b.v") -> str:
        r = f"{rest}[{q}].r" if told is None else f"{told} || CASE WHEN {rest}[{q}].r = '' THEN '' ELSE chr(10) || {rest}[{q}].r END"
        return f"{{'c': {rest}[{q}].c + {cost}, 't': '{letter}' || {rest}[{q}].t, 'r': {r}}}"

    never = "{'c': 1000000000::BIGINT, 't': '', 'r': ''}"
    plain = []
    for q in range(4):
        keep = " ".join(f"WHEN i = '{k}' THEN {then(to, 'stay', 'K', 'role || chr(58) || text')}" for k, to in lead[q].items())
        new = f"'{role[wanted[q]]}:' || text"
        plain.append(f"least({then(q + 1, '3', 'D', None)}, CASE WHEN go THEN {never} ELSE {then(ahead[q], 'stay + 2', 'R', new)} END, CASE WHEN go THEN {never} {keep} ELSE {never} END)")

    def insert(q: int, value: str) -> str:
        told = f"'{role[wanted[q]]}:'"
        return f"{{'c': {value}.c + 2, 't': 'I' || {value}.t, 'r': {told} || CASE WHEN {value}.r = '' THEN '' ELSE chr(10) || {value}.r END}}"

    closed = []
    for q in range(4):
        one = ahead[q] - 1
        two = ahead[one] - 1
        closed.append(f"least(p[{q + 1}], {insert(q, f'p[{one + 1}]')}, {insert(q, '(' + insert(one, f'p[{two + 1}]') + ')')})")
    end = f"[{{'c': 0::BIGINT, 't': '', 'r': ''}}, {{'c': 4::BIGINT, 't': 'II', 'r': 'user:' || chr(10) || 'assistant:'}}, {{'c': 2::BIGINT, 't': 'I', 'r': 'assistant:'}}, {{'c': 0::BIGINT, 't': '', 'r': ''}}]"
    return f"""
    WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    hurt AS (SELECT *, ({crc}) % 20 AS h FROM named),
    placed AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hurt WHERE h <> 0),
    ordered AS (SELECT *, row_number() OVER w AS k, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER w AS before
      FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM ordered),
    faults AS (SELECT *, NOT blank AND nth > 1 AS dup, NOT blank AND nth = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM seen),
    rs AS (SELECT conv_id, k, i, role, text, blank OR dup AS go, CASE WHEN cut THEN 1 ELSE 0 END AS stay FROM faults),
    best AS (SELECT conv_id, max(k) AS k, {end} AS v FROM rs GROUP BY 1
      UNION ALL SELECT conv_id, k - 1, [{', '.join(closed)}] FROM (SELECT b.conv_id, b.k, [{', '.join(plain)}] AS p FROM best b JOIN rs ON rs.conv_id IS NOT DISTINCT FROM b.conv_id AND rs.k = b.k)),
    sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
      count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE k > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
      coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].t, '') AS audit, sha256(coalesce(v[1].r, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id AND best.k = 0"""


@query("op13_conversation_repair", repair_sql())
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    from glyphmill.llm.conversations import audited

    return audited(table(spark, sf, "conversations"))
