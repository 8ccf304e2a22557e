"""The index's grams as DuckDB SQL, written from their definition: byte pairs' weights, and stretches whose inner pairs are lighter than both outer ones."""

from __future__ import annotations

from siftline.functions.ngrams import FNV_BASIS, FNV_PRIME, LONGEST, PAIR_1, PAIR_2, SHORTEST

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def grams(table: str, key: str, text: str) -> str:
    """CTEs that end in grams(k, gram): the distinct grams of each row's text, as hexadecimal digits; in bytes_of(k, n) each text's size."""
    pairs = range(1, LONGEST - 1)
    leads = ", ".join(f"lead(x, {d}) OVER o AS x{d}" for d in range(1, LONGEST)) + ", " + ", ".join(f"lead(w, {d}) OVER o AS w{d}" for d in pairs)

    def of(d: int) -> str:
        inner = [f"w{i}" for i in range(1, d)]
        lighter = f" AND greatest({', '.join(inner)}) < least(w, w{d})" if inner else ""
        return f"SELECT k, x || {' || '.join(f'x{i}' for i in range(1, d + SHORTEST - 1))} AS gram FROM near WHERE w{d} IS NOT NULL{lighter}"

    mixed = f"((v::HUGEINT * {PAIR_1} + v1::HUGEINT * {PAIR_2}) % 18446744073709551616)"
    return f"""
  texts AS (SELECT {key} AS k, regexp_extract_all(hex(encode({folded(text)})), '..') AS xs FROM {table}),
  bytes_of AS (SELECT k, len(xs) AS n FROM texts),
  places AS (SELECT k, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM texts),
  valued AS (SELECT k, i, x, ('0x' || x)::UTINYINT AS v, lead(('0x' || x)::UTINYINT) OVER (PARTITION BY k ORDER BY i) AS v1 FROM places),
  mixed AS (SELECT k, i, x, CASE WHEN v1 IS NOT NULL THEN {mixed} END AS m FROM valued),
  weighed AS (SELECT k, i, x, (m + (18446744073709551615 - m) // 140737488355328) % 4294967296 AS w FROM mixed),
  near AS (SELECT k, x, w, {leads} FROM weighed WINDOW o AS (PARTITION BY k ORDER BY i)),
  grams AS (SELECT DISTINCT k, gram FROM ({" UNION ALL ".join(of(d) for d in pairs)}))"""


#: FNV-1a of a gram's hexadecimal digits, as a signed long.
HASHED = (
    f"list_reduce(list_prepend({FNV_BASIS}::UHUGEINT, list_transform(regexp_extract_all(gram, '..'), lambda x: ('0x' || x)::UHUGEINT)), "
    f"lambda h, x: (xor(h::UBIGINT, x::UBIGINT)::UHUGEINT * {FNV_PRIME}) % 18446744073709551616)"
)
SIGNED = "(CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)::BIGINT"
