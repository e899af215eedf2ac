"""DuckDB SQL that lists the matches of patterns with their places, for checking span operators."""

from __future__ import annotations


def matches_sql(kinds: list[tuple[str, str, str]], source: str) -> str:
    """CTEs ending in ``found(doc_id, kind, o, s, b, e)``; kinds are (name, pattern, replacement), where the replacement
    puts chr(1) before and chr(2) after the part that counts. ``source`` has columns doc_id and t, t without those two."""
    marked = " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS kind, {o} AS o, string_split(regexp_replace(t, '{pattern}', {put}, 'g'), chr(1)) AS p FROM {source}"
        for o, (name, pattern, put) in enumerate(kinds)
    )
    return f"""marked AS ({marked}), found AS (
  SELECT doc_id, kind, o, string_split(p[i], chr(2))[1] AS s,
    list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::BIGINT - (i - 2) AS b,
    list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::BIGINT - (i - 2) + length(string_split(p[i], chr(2))[1]) AS e
  FROM marked, unnest(range(2, len(p) + 1)) AS r(i) WHERE len(p) > 1
)"""


WHOLE = "chr(1) || '\\0' || chr(2)"
PLAIN = "SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents"
