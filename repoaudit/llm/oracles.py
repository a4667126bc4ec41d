"""DuckDB SQL for the results of the operators that SQL can express."""

from __future__ import annotations

# Patterns as an engine without look-behind reads them: plain, leftmost, non-overlapping.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PII_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3"
    " AND (ltrim(p, '0') = '' OR CAST(left(ltrim(p, '0'), 3) AS INT) <= 255)))",
    "card": "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1),"
    " lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT)"
    " ELSE CAST(d[i] AS INT) * 2 - CASE WHEN CAST(d[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    "phone": "length(d) BETWEEN 9 AND 15",
}


def pii_base() -> str:
    """The columns of ``op2_pii`` but for ``spans``, which also holds spans of other kinds."""
    parts = []
    for at, (kind, pattern) in enumerate(_PII.items()):
        parts.append(
            f"""SELECT doc_id, {at} AS o, '{kind}' AS kind, s, s + length(m) AS e FROM (
              SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d,
                list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
              FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (
                SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms,
                  regexp_split_to_array(text, '{pattern}') AS gaps FROM documents WHERE text IS NOT NULL)))
            WHERE {_PII_VALID[kind]}"""
        )
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in _PII)
    return f"""WITH found AS ({' UNION ALL '.join(parts)}),
      per AS (SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY o, s) AS base
        FROM found GROUP BY doc_id)
      SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _PII)},
        sha256(coalesce(base, '')) AS base_sha256
      FROM documents d LEFT JOIN per USING (doc_id)"""


def fill_in_middle() -> str:
    """All columns of ``op12_fill_in_middle``. The hash of the text itself stands for the one rebuilt."""
    draws = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
      e AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {draws} FROM d),
      f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
          CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
            THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
      g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
      SELECT doc_id, n, form,
        CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
          ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM g"""
