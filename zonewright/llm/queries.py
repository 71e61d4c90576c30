"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm import chat_format, language_id, mtree
from zonewright.llm.common import table
from zonewright.llm.decontaminate import contaminated
from zonewright.llm.divergence import source_divergence
from zonewright.llm.jaccard import near_duplicates
from zonewright.llm.line_dedup import dedup_lines
from zonewright.llm.packing import pack_documents
from zonewright.llm.recompression import dedup_passages
from zonewright.llm.repair import digests, repair_conversations
from zonewright.llm.secrets import BREAK, KINDS, find_secrets, told
from zonewright.llm.suffix_dedup import dedup_substrings
from zonewright.llm.token_counts import token_counts


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
    WITH bytes AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    windows AS (
        SELECT doc_id, unnest(generate_series(0, len(h) // 2 - 100)) AS i,
               unnest(list_transform(generate_series(0, len(h) // 2 - 100),
                                     lambda i: substr(h, 2 * i + 1, 200))) AS win
        FROM bytes WHERE len(h) >= 200),
    starts AS (
        SELECT doc_id, i FROM windows
        QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
    islands AS (
        SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100
                             THEN 0 ELSE 1 END AS fresh FROM starts)),
    spans AS (
        SELECT doc_id, min(i) AS a, max(i) + 100 AS b,
               coalesce(lag(max(i) + 100) OVER (PARTITION BY doc_id ORDER BY min(i)), 0) AS before
        FROM islands GROUP BY doc_id, run),
    told AS (
        SELECT s.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
               string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
        FROM spans s JOIN bytes USING (doc_id) GROUP BY s.doc_id)
    SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
           coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
    FROM bytes d LEFT JOIN told t ON t.doc_id = d.doc_id"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    windows AS (
        SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i,
               unnest(list_transform(generate_series(1, len(w) - 12),
                                     lambda i: array_to_string(w[i:i + 12], ' '))) AS win
        FROM words WHERE len(w) >= 13),
    starts AS (
        SELECT doc_id, i FROM windows
        QUALIFY doc_id > min(doc_id) OVER (PARTITION BY win)),
    covered AS (
        SELECT DISTINCT doc_id, i + k AS i
        FROM starts CROSS JOIN (SELECT unnest(generate_series(0, 12)) AS k)),
    each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words)
    SELECT d.doc_id, count(e.i) AS n_words, count(c.i) AS n_removed,
           sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (c.i IS NULL), ''))
               AS kept_sha256
    FROM documents d LEFT JOIN each e ON e.doc_id = d.doc_id
    LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.i = e.i
    GROUP BY d.doc_id"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    marked AS (
        SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone
        FROM keyed)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), ''))
               AS kept_sha256
    FROM marked GROUP BY doc_id"""


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP4_SQL = """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM pairs
    WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER best <= 20"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
    WITH RECURSIVE docs AS (
        SELECT row_number() OVER () AS id, doc_id,
               regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
    grams AS (
        SELECT DISTINCT id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS gram
        FROM (SELECT *, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i
              FROM docs WHERE len(w) > 0)),
    sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
    shared AS (
        SELECT a.id AS a, b.id AS b, count(*) AS n
        FROM grams a JOIN grams b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL),
    near AS (
        SELECT a, b FROM shared s JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
        WHERE 5 * s.n >= 4 * (x.n + y.n - s.n)),
    links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    reached AS (
        SELECT id AS a, id AS b FROM docs
        UNION
        SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
    classes AS (SELECT r.a, min(d.doc_id) AS class_id FROM reached r JOIN docs d ON d.id = r.b GROUP BY r.a)
    SELECT d.doc_id, c.class_id, (SELECT count(*) FROM links l WHERE l.a = d.id) AS n_links
    FROM docs d JOIN classes c ON c.a = d.id"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), model)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
    WITH words AS (
        SELECT 'd' AS side, doc_id AS id, list_filter(
            string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
        FROM documents
        UNION ALL
        SELECT 'b', item_id, list_filter(
            string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')
        FROM benchmark),
    grams AS (
        SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS gram
        FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)),
    items AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM grams WHERE side = 'b')
    SELECT d.id AS doc_id, b.id AS item_id, b.n AS n_grams, count(*) AS n_shared,
           count(*) / b.n AS containment
    FROM items b JOIN grams d ON d.side = 'd' AND d.gram = b.gram
    GROUP BY d.id, b.id, b.n HAVING count(*) >= ceil(0.8 * b.n - 1e-9)"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~out))
    return (
        language_id.identify(docs, model)
        .withColumn("held_out", out)
        .select("doc_id", "held_out", "lang_pred", "score")
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    chats = chat_format.format_chats(rows.unionByName(own))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    told = chat_format.under_loss(F.col("formatted"), F.col("loss_runs"))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(told).cast("long").alias("loss_chars"),
        F.sha2(told, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
    WITH chats AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                         (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    escaped AS (
        SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'),
                                 '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS safe,
               regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<\\\1\2', 'g'),
                              '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS safe_role
        FROM chats)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
               AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                           FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(CASE WHEN role = 'assistant' THEN 7 + length(safe)
                    ELSE 16 + length(safe_role) + length(safe) END)::BIGINT AS formatted_chars
    FROM escaped GROUP BY conv_id"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents),
    words AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    counts AS (
        SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term)
        GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
    sources AS (SELECT DISTINCT lang, source FROM docs),
    shares AS (
        SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
               1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * l.v) AS p,
               1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
        FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang)
        LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source
        LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
        FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
        LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
        GROUP BY ALL),
    items AS (
        SELECT lang, source, 'pair' AS part, item, value FROM pairs
        UNION ALL
        SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
    SELECT *, (row_number() OVER best)::INTEGER AS rank FROM items
    WINDOW best AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
    QUALIFY part = 'pair' OR row_number() OVER best <= 50"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.strong],
        F.sha2(told(F.filter("spans", lambda s: s["strong"])), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def _op12_matches(i: int, pattern: str, good: str, group: int = 0) -> str:
    """The matches of a kind with the sum of what lies before and in each."""
    quoted = pattern.replace("'", "''")
    return f"""
        SELECT id, {i} AS kind, nth, {good} AS ok, length(m) AS size,
               sum(length(p) + length(m)) OVER (PARTITION BY id ORDER BY nth) AS e
        FROM (SELECT id, unnest(regexp_extract_all(text, '{quoted}')) AS m,
                     unnest(regexp_extract_all(text, '{quoted}', {group})) AS v,
                     unnest(string_split_regex(text, '{quoted}')[:-2]) AS p,
                     generate_subscripts(regexp_extract_all(text, '{quoted}'), 1) AS nth
              FROM docs WHERE regexp_matches(text, '{quoted}'))"""


def _op12_good(kind) -> str:
    good = f"length(v) BETWEEN {kind.least} AND {kind.most}"
    if kind.mixed:
        good += "".join(f" AND regexp_matches(v, '{c}')" for c in ("[0-9]", "[A-Z]", "[a-z]"))
    return good


def _op12_table() -> str:
    rows = [f"({i}, '{k.name}', '{k.role}', {k.strong})" for i, k in enumerate(KINDS)]
    return "(VALUES " + ", ".join(rows) + ") k(kind, name, role, strong)"


OP12_SQL = f"""
    WITH docs AS (
        SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    matches AS ({
    " UNION ALL ".join(
        [_op12_matches(i, k.pattern, _op12_good(k), k.group) for i, k in enumerate(KINDS)]
        + [_op12_matches(len(KINDS), BREAK, "true")]
    )
}),
    parts AS (
        SELECT m.id, m.kind, name, role, strong, (e - size)::BIGINT AS s, e::BIGINT AS e,
               (SELECT count(*) FROM matches b
                WHERE b.kind = {len(KINDS)} AND b.id = m.id AND b.e - b.size < m.e - m.size) AS scope
        FROM matches m JOIN {_op12_table()} ON m.kind = k.kind WHERE ok),
    linked AS (
        SELECT a.id, a.kind, a.name, false AS strong, a.s, a.e FROM parts a JOIN parts b
        ON a.id = b.id AND a.scope = b.scope AND a.role <> b.role
           AND b.s <= a.e + 200 AND b.e >= a.s - 200
        WHERE NOT a.strong
        GROUP BY ALL HAVING bool_or(b.strong) OR count(DISTINCT b.role) = 2),
    spans AS (
        SELECT id, kind, name, strong, s, e FROM parts WHERE strong
        UNION ALL SELECT * FROM linked),
    told AS (
        SELECT id, count(*) FILTER (name = 'assign') AS n_assign,
               count(*) FILTER (name = 'access') AS n_access,
               count(*) FILTER (name = 'hex') AS n_hex,
               string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (strong) AS base,
               string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
        FROM spans GROUP BY id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans
    FROM docs LEFT JOIN told ON told.id = docs.id"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    said = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text("text"), "[.!?]", ""))
    damaged = rows.where(harm > 0).select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(text("role")).alias("role"),
        said.otherwise(text("text")).alias("text"),
        F.explode(F.when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    reports, turns = repair_conversations(damaged)
    told = reports.unionByName(rows.select(F.col("conv_id").alias("conv")).distinct(), True)
    told = told.unionByName(digests(turns), True)
    # one exchange brings together what is known of a conversation, null ids too
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256().hexdigest()
    return told.groupBy(F.col("conv").alias("conv_id")).agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.lit(nothing)).alias("repaired_sha256"),
    )


OP13_SQL = """
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce(list_concat([i::BIGINT], range(8)::BIGINT[]), lambda c, k:
                    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM range(256) r(i)),
    named AS (
        SELECT coalesce('=' || conv_id, '') AS conv, conv_id, turn, coalesce(role, ' ') AS role,
               coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
        FROM conversations),
    hashed AS (
        SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
                   range(0, strlen(k)), lambda j: ('0x' || substr(hex(encode(k)), 2 * j + 1, 2))::BIGINT)),
                   lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 20 AS harm
        FROM named, crc),
    rows AS (
        SELECT conv, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
               CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END))
        FROM hashed WHERE harm <> 0),
    ordered AS (
        SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv) AS n,
               lag(left(role, 1)) OVER w || left(role, 1) AS pair,
               regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body
        FROM rows WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text)),
    faulty AS (
        SELECT *, CASE WHEN body = '' THEN 'blank'
                       WHEN i > min(i) OVER (PARTITION BY conv, role, text) THEN 'duplicate'
                       WHEN NOT regexp_matches(body, '[.!?]$') THEN 'truncated' ELSE '' END AS fault
        FROM ordered),
    counts AS (
        SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
        FROM faulty GROUP BY conv),
    moves(a, r, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
    inserts AS (
        SELECT DISTINCT a, '' AS w, 0 AS cost, a AS b, []::VARCHAR[] AS said FROM (SELECT unnest(range(4))::INTEGER AS a)
        UNION ALL
        SELECT a, 'I', 5, b, [if(r = 'u', 'user:', 'assistant:')] FROM moves WHERE r <> 's'
        UNION ALL
        SELECT x.a, 'II', 10, y.b, [if(x.r = 'u', 'user:', 'assistant:'), if(y.r = 'u', 'user:', 'assistant:')]
        FROM moves x JOIN moves y ON x.b = y.a WHERE x.r <> 's' AND y.r <> 's'),
    edits AS (
        SELECT conv, i, a, 'D' AS w, 2 AS cost, a AS b, []::VARCHAR[] AS said
        FROM faulty, (SELECT unnest(range(4))::INTEGER AS a)
        UNION ALL
        SELECT conv, i, a, 'K', if(fault = '', 0, 5), b, [role || ':' || text]
        FROM faulty JOIN moves ON left(role, 1) = r WHERE fault IN ('', 'truncated')
        UNION ALL
        SELECT conv, i, a, 'R', if(fault = '', 1, 6), b, [if(r = 'u', 'user:', 'assistant:') || text]
        FROM faulty JOIN moves ON r <> 's' WHERE fault IN ('', 'truncated')),
    steps AS (
        SELECT e.conv, e.i, n.a, n.w || e.w AS w, n.cost + e.cost AS cost, e.b, list_concat(n.said, e.said) AS said
        FROM inserts n JOIN edits e ON n.b = e.a),
    best(conv, i, state, cost, audit, said) AS (
        SELECT DISTINCT conv, 1::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM named
        UNION ALL
        SELECT conv, i, state, cost, audit, said FROM (
            SELECT p.conv, p.i + 1 AS i, s.b AS state, p.cost + s.cost AS cost, p.audit || s.w AS audit,
                   list_concat(p.said, s.said) AS said
            FROM best p JOIN steps s ON s.conv = p.conv AND s.i = p.i AND s.a = p.state)
        QUALIFY row_number() OVER (PARTITION BY conv, state ORDER BY cost, audit) = 1),
    ends AS (
        SELECT p.conv, p.cost + n.cost AS cost, p.audit || n.w AS audit, list_concat(p.said, n.said) AS said
        FROM best p LEFT JOIN counts c ON c.conv = p.conv JOIN inserts n ON n.a = p.state
        WHERE p.i = coalesce(c.n, 0) + 1 AND n.b IN (0, 3)
        QUALIFY row_number() OVER (PARTITION BY p.conv ORDER BY p.cost + n.cost, p.audit || n.w) = 1),
    convs AS (SELECT DISTINCT conv, conv_id FROM named)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
           coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit,
           sha256(array_to_string(said, chr(10))) AS repaired_sha256
    FROM convs JOIN ends USING (conv) LEFT JOIN counts USING (conv)"""


def queries() -> dict:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_token_counts": op6_token_counts,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_language_id": op9_language_id,
        "op10_chat_format": op10_chat_format,
        "op11_source_divergence": op11_source_divergence,
        "op12_secret_scan": op12_secret_scan,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": OP1_SQL,
        "op2_substring_dedup": OP2_SQL,
        "op3_line_dedup": OP3_SQL,
        "op4_exact_top_k": OP4_SQL,
        "op5_ngram_jaccard_join": OP5_SQL,
        "op7_benchmark_decontamination": OP7_SQL,
        "op10_chat_format": OP10_SQL,
        "op11_source_divergence": OP11_SQL,
        "op12_secret_scan": OP12_SQL,
        "op13_conversation_repair": OP13_SQL,
    }
