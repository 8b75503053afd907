"""DuckDB SQL of the queries that SQL can express, written for itself."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"

EXACT = f"""WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.h AS text_sha256 FROM n JOIN g ON g.h = n.h"""

_STOPS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les en un du une que pour est dans qui par au sur pas avec "
    "el y los se las del por con no una su para al es lo"
).split()

RULES = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
p AS (SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) AS q),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM p) AS q WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM r, range(3) AS x(d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  length(text) - length(replace(text, '!', '')) AS bangs, len(list_filter(ws, lambda x: list_contains({_STOPS!r}, lower(x)))) AS stops,
  len(list_filter(ls, lambda x: regexp_matches(x, '([.][.][.]|…) *$'))) AS dots, len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•]'))) AS bullets FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 3.0 AND 12.0 AND n_symbols / n_words <= 0.05 AND bangs / n_words <= 0.1 AND dots / n_lines <= 0.3 AND bullets / n_lines <= 0.9 AND n_dup_lines / n_lines <= 0.4 AND n_repeat_words / n_words <= 0.5 AND stops / n_words >= 0.02 AS kept FROM b"""


def _crc_steps() -> list[int]:
    """The CRC-32 table, from its polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def shards(count: int, seed: int) -> str:
    return f"""WITH h AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, source, len(x) // 2 AS n, list_transform(regexp_extract_all(x, '..'), lambda v: CAST('0x' || v AS BIGINT)) AS bytes FROM h),
k AS (SELECT doc_id, source, n + 16 AS size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, list_extract({_crc_steps()!r}, (xor(c, v) & 255) + 1))), 4294967295) AS text_crc32,
  CAST('0x' || md5('{seed}:' || CAST(doc_id AS VARCHAR))[1:15] AS BIGINT) AS key FROM b),
z AS (SELECT *, greatest(16, CAST(ceil((SELECT count(*) FROM documents) / 50000.0) AS BIGINT)) AS buckets FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key % buckets, key, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS of FROM z),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / of, source IS NULL, source, rank) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, CAST(place * {count} // total AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(place - ceil(CAST(shard AS BIGINT) * total / {count}.0) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _levels(name: str, start: str) -> str:
    """All levels of trees of threes: t, l, i, h, n."""
    return f"""{name} AS ({start} UNION ALL
  SELECT t, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY t, l, i // 3, n)"""


def _ways(name: str, levels: str, start: str) -> str:
    """From each k up: siblings so far and the folded digest."""
    return f"""{name}_runs AS (SELECT t, l, i // 3 AS r, list(h ORDER BY i) AS hs FROM {levels} WHERE n > 1 GROUP BY t, l, i // 3),
{name} AS ({start} UNION ALL
  SELECT k, w.t, w.l + 1, i // 3, (n + 2) // 3, proof || array_to_string(hs[1:i % 3], '') || array_to_string(hs[i % 3 + 2:], ''),
    sha256(array_to_string(hs[1:i % 3], '') || folded || array_to_string(hs[i % 3 + 2:], '')) FROM {name} w JOIN {name}_runs g ON g.t = w.t AND g.l = w.l AND g.r = w.i // 3 WHERE n > 1)"""


MERKLE = f"""WITH RECURSIVE bytes AS (SELECT *, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda v: CAST('0x' || v AS BIGINT)) AS bs FROM documents),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, bs), lambda c, v: xor(c >> 8, list_extract({_crc_steps()!r}, (xor(c, v) & 255) + 1))), 4294967295) AS crc FROM bytes),
found AS (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen FROM crc),
digests AS (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("seen")} AS now FROM found),
leaves AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM digests),
{_levels("low", "SELECT t, 0 AS l, i, leaf AS h, n FROM leaves")},
subroots AS (SELECT t AS q, h AS subroot FROM low WHERE n = 1),
{_levels("high", "SELECT 0 AS t, 0 AS l, q AS i, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots")},
{_ways("up", "low", "SELECT k, t, 0 AS l, i, n, '' AS proof, now AS folded FROM leaves")},
{_ways("top", "high", "SELECT k, 0 AS t, 0 AS l, t AS i, (SELECT count(*) FROM subroots) AS n, proof, folded FROM up WHERE n = 1")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM leaves JOIN subroots ON q = leaves.t JOIN top ON top.k = leaves.k AND top.n = 1 JOIN high ON high.n = 1"""
