"""The registered query of each operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.llm import (
    bitpack, bpe, counts, dedup, dialogue, divergence, jaccard, langid, lm, neardup, packing, pii, topk,
)
from shiftledger.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized("embedding").alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op6_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitpack.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return bitpack.read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return dialogue.summary(dialogue.repair(dialogue.damaged(conversations)), conversations)


def op13_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_top_k": op3_top_k,
    "op4_language_model": op4_language_model,
    "op5_personal_data": op5_personal_data,
    "op6_bitpack": op6_bitpack,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_near_duplicates": op13_near_duplicates,
}


def _least(*states: str) -> str:
    """The cheapest of some states, then the first audit."""
    return f"list_min([{', '.join(states)}])"


def _edit(state: str, letter: str, cost: str, line: str = "") -> str:
    said = f" || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) END || {line}" if line else ""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r{said}}}"


def _repair_sql() -> str:
    """The edits by a walk from the front: per state the least (cost, audit) so far, each with its repaired lines."""
    none = "{'c': 1000000, 'a': '', 'r': ''}"
    inserted = lambda state, role: _edit(state, "I", "5", f"'{role}:'")
    fault = "CASE WHEN cut THEN 5 ELSE 0 END"
    own = "role || ':' || text"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN NOT gone AND i = '{initial}' THEN {_edit(state, 'K', fault, own)} ELSE {none} END"

    def named(state: str, role: str) -> str:
        line = f"'{role}:' || text"
        return f"CASE WHEN NOT gone THEN {_edit(state, 'R', f'1 + {fault}', line)} ELSE {none} END"

    deleted = lambda state: _edit(state, "D", "2")
    user = _least(deleted("u"), *[f(s, x) for s in ("z", "s", "a") for f, x in ((kept, "u"), (named, "user"))])
    opened = f"""SELECT key, n, z, s, u, {_least('a', inserted('u', 'assistant'))} AS a FROM (
        SELECT key, n, z, s, a, {_least('u', *[inserted(x, 'user') for x in ('z', 's', 'a')])} AS u FROM walk)"""
    return rf"""
        WITH RECURSIVE given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
                       string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda x: [unicode(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                       lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) AS crc
            FROM conversations
        ), told AS (
            SELECT coalesce('=' || conv_id, '') AS key, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
                   CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy
            FROM (SELECT *, xor(crc, 4294967295) % 20 AS m FROM given) WHERE m <> 0
        ), placed AS (
            SELECT *, left(role, 1) AS i, regexp_replace(text, '[ 	-
]+$', '') AS bare,
                   row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n
            FROM told
        ), judged AS (
            SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY key, role, text ORDER BY n) > 1 AS again,
                   lag(i) OVER (PARTITION BY key ORDER BY n) || i AS pair
            FROM placed
        ), rows AS (
            SELECT *, blank OR again AS gone, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM judged
        ), walk AS (
            SELECT DISTINCT key, 0::BIGINT AS n, {{'c': 0, 'a': '', 'r': ''}} AS z, {none} AS s, {none} AS u, {none} AS a FROM rows
            UNION ALL
            SELECT key, n, {deleted('z')}, {_least(deleted('s'), kept('z', 's'))}, {user},
                   {_least(deleted('a'), kept('u', 'a'), named('u', 'assistant'))}
            FROM (SELECT o.key, r.n, o.z, o.s, o.u, o.a, r.i, r.gone, r.cut, r.role, r.text FROM ({opened}) o
                  JOIN rows r ON r.key = o.key AND r.n = o.n + 1)
        ), ended AS (
            SELECT key, {_least('z', 'a')} AS best FROM ({opened}) QUALIFY n = max(n) OVER (PARTITION BY key)
        ), counted AS (
            SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                   count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM rows GROUP BY key
        )
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
               coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN counted n ON n.key = coalesce('=' || c.conv_id, '') LEFT JOIN ended e ON e.key = n.key"""


ORACLE_SQL: dict[str, str] = {
    "op3_top_k": r"""
        WITH vectors AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.n AS query_row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.n <> c.n AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id)::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op8_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
            FROM documents
        ), ranked AS (
            SELECT doc_id, content, count(*) OVER (PARTITION BY content) AS group_size,
                   first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
            FROM rows
            WINDOW w AS (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM ranked""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'
            ), lambda x: x <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) < 5 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '')
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words
        ), members AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), steps AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach(doc_id, root) AS (
            SELECT doc_id, doc_id FROM sets UNION SELECT s.b, r.root FROM reach r JOIN steps s ON s.a = r.doc_id
        )
        SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(r.root) AS component_id
        FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id""",
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), words AS (
            SELECT n, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), kept AS (
            SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT n) >= 3
        ), groups AS (
            SELECT DISTINCT lang, source FROM d
        ), v AS (
            SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang
        ), counts AS (
            SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL
        ), sizes AS (
            SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
        ), p AS (
            SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c,
                   1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (s.n + v.v) AS p
            FROM sizes s JOIN kept k ON k.lang = s.lang JOIN v ON v.lang = s.lang
            LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        ), whole AS (
            SELECT p.lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(t.n) + any_value(v.v)) AS q
            FROM p JOIN v ON v.lang = p.lang JOIN (SELECT lang, sum(n) AS n FROM sizes GROUP BY lang) t ON t.lang = p.lang GROUP BY p.lang, term
        ), found AS (
            SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(f.value, 0)::BIGINT AS value
            FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN (
                SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term GROUP BY ALL
            ) f ON f.lang = g.lang AND f.source = g.source AND f.other = o.source
            UNION ALL
            SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT
            FROM p JOIN whole w ON w.lang = p.lang AND w.term = p.term WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op12_conversation_repair": _repair_sql(),
    "op13_near_duplicates": r"""
        WITH RECURSIVE given AS (
            SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), fit AS (
            SELECT n, label, e, sqrt(list_inner_product(e, e)) AS size FROM given
            WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.n AS a, b.n AS b FROM fit a JOIN fit b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e)
            WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98
        ), reach(n, root) AS (
            SELECT n, n FROM given UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.n
        ), named AS (
            SELECT r.n, min(g.vec_id) AS component_id FROM reach r JOIN given g ON g.n = r.root GROUP BY r.n
        )
        SELECT g.vec_id, (SELECT count(*) FROM links l WHERE l.a = g.n) AS n_links, m.component_id,
               g.vec_id IS NOT DISTINCT FROM m.component_id AS kept
        FROM given g JOIN named m USING (n)""",
}
