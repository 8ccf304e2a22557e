"""DuckDB SQL for the fixed columns of queries whose other columns SQL can't express."""

from __future__ import annotations

_T = "t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spans(kinds: list[tuple[str, str, str]]) -> str:
    """CTE spans(doc_id, kind, k, s, e): (kind, pattern, test of a match m) of each kind. A match begins behind the gaps and matches before it."""
    one = (
        "SELECT doc_id, '{0}' AS kind, {3} AS k, s, s + length(m) AS e FROM (SELECT doc_id, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) "
        "+ coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM "
        "(SELECT doc_id, regexp_extract_all(t, '{1}') AS ms, string_split_regex(t, '{1}') AS gaps FROM t WHERE regexp_matches(t, '{1}')))) WHERE {2}"
    )
    return f"{_T}, spans AS (" + " UNION ALL ".join(one.format(*kind, k) for k, kind in enumerate(kinds)) + ")"


def _digest(kinds: list[tuple[str, str, str]], order: str) -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in kinds)
    return (
        f"WITH {_spans(kinds)} SELECT documents.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY {order}), '')) AS base_sha256 "
        "FROM documents LEFT JOIN spans USING (doc_id) GROUP BY documents.doc_id"
    )


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# A run of too few characters holds no match in any of its parts, so the least lengths can stand in the patterns.
_VALUE = r"""["'']?\x20*[:=]\x20*["'']?"""
_KEY = "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
SECRETS = _digest(
    [
        ("assign", _KEY + _VALUE + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '^{_KEY}{_VALUE}([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
        ("access", "AKIA[A-Z0-9]{16,}", "true"),
        ("hex", "[0-9a-f]{24,}", "true"),
    ],
    "s, k",
)
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_DOUBLED = f"substr({_DIGITS}, length({_DIGITS}) - i::INT, 1)::INT * (i % 2 + 1)"
PERSONAL = _digest(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda i: {_DOUBLED} - CASE WHEN {_DOUBLED} > 9 THEN 9 ELSE 0 END)) % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ],
    "k, s",
)

LICENSES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS a FROM d),
n AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (
  SELECT doc_id, i, 'cc-by' AS label FROM n WHERE a = 'cc' AND b = 'by'
  UNION ALL SELECT doc_id, i, 'gpl' FROM n WHERE a = 'general' AND b = 'public' AND c = 'license'
  UNION ALL SELECT doc_id, i, 'reserved' FROM n WHERE a = 'all' AND b = 'rights' AND c = 'reserved')
SELECT d.doc_id, any_value(len(ws))::BIGINT AS n_words, count(p.i) AS n_base, min(p.i) AS first_word, max(p.i) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id
"""

QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS a FROM d),
n AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM n WHERE c IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""

SHARDS = """
WITH s AS (SELECT doc_id, md5(coalesce(text, '')) AS h, coalesce(doc_id::VARCHAR, '') AS id, strlen(coalesce(text, ''))::BIGINT + 1 AS size FROM documents),
o AS (SELECT *, sum(size) OVER (ORDER BY h, id) AS upto, sum(size) OVER () AS total FROM s),
p AS (SELECT *, least(7, floor((upto - size / 2) * 8 / total::DOUBLE))::INT AS shard FROM o)
SELECT doc_id, size, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, id) - 1 AS slot FROM p
"""
