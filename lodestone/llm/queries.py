"""Registered queries of the document operators, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm import bpe, chat, decontaminate, exact_dedup, hard_negatives, jaccard_join, passages, quality, resampling, sharding, simhash, suffix_dedup, toxicity

QUERIES = {
    "op6_passages": passages.op6_passages,
    "op3_chat": chat.op3_chat,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op9_quality": quality.op9_quality,
    "op1_toxicity": toxicity.op1_toxicity,
    "op4_bpe": bpe.op4_bpe,
    "op8_simhash": simhash.op8_simhash,
    "op11_resampling": resampling.op11_resampling,
    "op12_jaccard_join": jaccard_join.op12_jaccard_join,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
    """,
    # the escaped length: a character more for each backslash, control string and line break in a role
    "op3_chat": r"""
        WITH rows_ AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text)),
        sized AS (
          SELECT *, length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '(<</SYS>>|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>)', '_\1', 'g')) AS text_size,
                 length(regexp_replace(replace(role, chr(92), chr(92) || chr(92)), '(<</SYS>>|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>)', '_\1', 'g'))
                   + length(role) - length(replace(role, chr(10), '')) AS role_size
          FROM rows_)
        SELECT CAST(conv_id AS BIGINT) AS conv_id, COUNT(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(SUM(3 + role_size + 1 + text_size + 4) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY 1
    """,
    # CRC-32 by its table of 256 values, once for each different word
    "op11_resampling": r"""
        WITH crc AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda x: 0::UBIGINT)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        e AS MATERIALIZED (SELECT r, unnest(w) AS w FROM d),
        v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM e UNION SELECT w FROM b)),
        k AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(w)), lambda i: (16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::UBIGINT)), lambda c, x: xor(t[(xor(c, x) & 255)::INT + 1], c >> 8)), 4294967295::UBIGINT) % 10000 AS bucket FROM v, crc),
        s AS (SELECT bucket, COUNT(*) AS n FROM e JOIN k USING (w) GROUP BY 1),
        t AS (SELECT bucket, COUNT(*) AS n FROM b JOIN k USING (w) GROUP BY 1),
        g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT COUNT(*) FROM e) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1) * ((SELECT COUNT(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
        x AS (SELECT r, CAST(SUM(gain) AS BIGINT) AS weight FROM e JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
        y AS (SELECT d.doc_id, len(d.w) AS n_features, coalesce(x.weight, 0) AS weight, list_reduce(list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i]) - 1 AS BIGINT)), lambda p, q: p * 16 + q) AS h FROM d LEFT JOIN x USING (r)),
        z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM y),
        o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, COUNT(*) OVER (PARTITION BY n_features >= 20) AS all_ FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * all_ // 100 THEN place END AS rank FROM o
    """,
    "op12_jaccard_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        n AS MATERIALIZED (SELECT r, doc_id, len(s) AS n FROM s),
        e AS MATERIALIZED (SELECT r, unnest(s) AS g FROM s),
        p AS (SELECT a.r AS a, b.r AS b, COUNT(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
        c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a)
        SELECT n.doc_id, n.n AS n_shingles, MIN(m.doc_id) AS component_id FROM n JOIN c ON c.a = n.r JOIN n m ON m.r = c.b GROUP BY n.r, n.doc_id, n.n
    """,
    "op13_hard_negatives": """
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
                                FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
        m AS MATERIALIZED (SELECT a.r AS r, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
                           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND NOT (a.label = b.label AND a.vec_id = b.vec_id)),
        p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS place FROM m WHERE same QUALIFY place <= 5)
        SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.place ORDER BY n.score DESC, n.other) AS INT) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN m n ON n.r = p.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5
    """,
}
