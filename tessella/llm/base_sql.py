"""DuckDB SQL for the parts of operators 2, 3, 5 and 9 that rules fix, and queries that take those parts from the operators' own results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.fingerprint import op9_fingerprints
from tessella.llm.langid import UND, op2_language_id
from tessella.llm.pii import op3_pii
from tessella.llm.secrets import op5_secrets


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _spans_sql(kinds: list[tuple[str, str, int, str]]) -> str:
    """kinds: (name, pattern, group, condition on that group's text g).  Counts and the digest of all spans, for every document."""
    parts = []
    for k, (name, pattern, group, valid) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        parts.append(f"""m{k} AS (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms, regexp_extract_all(t, '{quoted}', {group}) AS gs, list_transform(regexp_split_to_array(t, '{quoted}'), lambda p: length(p)) AS ps
  FROM d WHERE regexp_matches(t, '{quoted}')),
i{k} AS (SELECT doc_id, gs, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m{k}),
s{k} AS (SELECT doc_id, {k} AS k, '{name}' AS kind, gs[i] AS g, (list_sum(ps[1:i]) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(ms[i]) AS n FROM i{k}),
v{k} AS (SELECT doc_id, k, kind, s, s + n AS e FROM s{k} WHERE {valid})""")
    every = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(len(kinds)))
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k})::BIGINT AS n_{kind[0]}" for k, kind in enumerate(kinds))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(parts)}, a AS ({every})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '')) AS base_sha256 FROM d LEFT JOIN a ON d.doc_id = a.doc_id GROUP BY d.doc_id"""


_DIGITS = "regexp_replace(g, '[^0-9]', '', 'g')"
_DOUBLED = f"list_transform(range(1, length({_DIGITS}) + 1), lambda i: ((ascii({_DIGITS}[-i]) - 48) * (2 - i % 2) // 10 + (ascii({_DIGITS}[-i]) - 48) * (2 - i % 2) % 10))"
PII_SQL = _spans_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, "len(list_filter(string_split(g, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", 0, f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum({_DOUBLED}) % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ]
)
SECRET_SQL = _spans_sql(
    [
        ("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(g) >= 8"),
        ("access", r"AKIA[A-Z0-9]+", 0, "length(g) >= 16"),
        ("hex", r"[0-9a-f]{32,}", 0, "true"),
    ]
)
EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM d)
SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 2) || left(following, n // 2)) AS edited_sha256 FROM n
"""
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT), lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"
RULES_SQL = rf"""
SELECT doc_id, xor({_CRC}, 4294967295::BIGINT) % 3 = 1 AS held_out, NOT regexp_matches(coalesce(text, ''), '\p{{L}}') AS undetermined
FROM (SELECT doc_id, text, doc_id::VARCHAR AS id FROM documents)
"""


def pii_base_spans(spark, sf_dir: str) -> DataFrame:
    return op3_pii(spark, sf_dir).drop("spans")


def secret_base_spans(spark, sf_dir: str) -> DataFrame:
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def fingerprint_edits(spark, sf_dir: str) -> DataFrame:
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def language_rules(spark, sf_dir: str) -> DataFrame:
    return op2_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == UND).alias("undetermined"))


QUERIES = {f.__name__: f for f in (pii_base_spans, secret_base_spans, fingerprint_edits, language_rules)}
ORACLES = {"pii_base_spans": PII_SQL, "secret_base_spans": SECRET_SQL, "fingerprint_edits": EDITS_SQL, "language_rules": RULES_SQL}
