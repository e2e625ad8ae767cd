"""SQL for the queries that SQL can express; they are written from the definitions, not from the operators."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT item, list_slice(w, i, least(i + 9, len(w))) AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS l FROM wins),
d AS (SELECT doc_id, i, l, list_slice(w, i, i + l - 1) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), lens WHERE i + l - 1 <= len(w)),
h AS (SELECT doc_id, i, l, item FROM d JOIN wins USING (win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def _base32(hexadecimal: str) -> str:
    """SQL for the base-32 form of 40 hexadecimal digits: five of them make four characters."""
    parts = []
    for g in range(8):
        value = " + ".join(f"(instr('0123456789abcdef', substr({hexadecimal}, {5 * g + k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5))
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({value}) // {32 ** (3 - c)}) % 32 AS INTEGER) + 1, 1)" for c in range(4)]
    return " || ".join(parts)


WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, lower(sha1(h)) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_base32('x')} AS payload_digest,
CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM d
"""

_REST = r"\|(?:turn|text|end|im_start|im_end|endoftext|startoftext|system|user|assistant)\||/?INST\]|/?s>|<?/?SYS>>|start_of_turn>|end_of_turn>"
_ESCAPED = "length(regexp_replace({0}, '([<\\[])(\\\\*)(" + _REST + ")', '\\1\\\\\\2\\3', 'g'))"

CHAT = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(length('<s></s>') + sum(length('<|turn|><|text|><|end|>' || chr(10)) + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op3_decontamination": DECONTAMINATION, "op4_warc": WARC, "op6_chat": CHAT}
