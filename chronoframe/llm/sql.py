"""DuckDB SQL that says what a query says, where SQL can."""

from __future__ import annotations

from chronoframe.llm import secrets


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def secret_scans(most_owners: int = 2, most_repos: int = 4) -> str:
    """Matches are placed by the text between them, as in the operator; owners and repositories are counted per value."""
    parts = []
    for number, (name, pattern, group, least) in enumerate(secrets.KINDS):
        p = _text(pattern)
        value = f"regexp_extract(m, {p}, {group})" if group else "m"
        parts.append(
            f"SELECT row, owner, repo, {number} AS kind, '{name}' AS name, m, {value} AS value, {least} AS least, i, gap FROM (SELECT row, owner, repo, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gaps[1 : len(ms)]) AS gap "
            f"FROM (SELECT row, owner, repo, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p})) a) b"
        )
    base = secrets.BASE
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || chr(1) || coalesce(lang, '') AS repo FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM m),
s AS (SELECT row, owner, repo, kind, name, value, CAST(e - length(m) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p WHERE length(value) >= least AND (kind < {base} OR (length(regexp_replace(value, '[^0-9]', '', 'g')) >= {secrets.DIGITS} AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= {secrets.LETTERS} AND len(list_distinct(string_split(value, ''))) >= {secrets.DIFFERENT}))),
o AS (SELECT value, count(DISTINCT owner) <= {most_owners} AND count(DISTINCT (owner, repo)) <= {most_repos} AS live FROM s GROUP BY value),
j AS (SELECT s.*, o.live FROM s JOIN o ON s.value = o.value WHERE kind < {base} OR o.live),
f AS (SELECT * FROM j WHERE kind < {base} OR NOT EXISTS (SELECT 1 FROM j k WHERE k.row = j.row AND k.kind < {base} AND k.b <= j.b AND j.e <= k.e)),
g AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) FILTER (kind < {base}) AS base, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM f GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g ON d.row = g.row"""
