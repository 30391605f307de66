"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import decontamination, divergence, jaccard_join, licenses, mixing, packing, pii, prefix_trie, quality_rules, substring_dedup, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_licenses": licenses.op2_licenses,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_packing": packing.op7_packing,
        "op8_warc": warc.op8_warc,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_mixing": mixing.op11_mixing,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_source_divergence": divergence.op13_source_divergence,
        "pii_base": pii.pii_base,
        "quality_counts": quality_rules.quality_counts,
        "byte_length_sums": token_counts.byte_length_sums,
    }


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_PII = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(f"SELECT id, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d" for k, kind, pattern in ((0, "email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"), (1, "ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"), (2, "card", "[0-9](?:[ -]?[0-9])+"), (3, "phone", "[+][0-9][ ().0-9-]+[0-9]")))}),
e AS (SELECT id, k, kind, ms[i] AS m, list_sum([length(x) FOR x IN ps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f)),
g AS (SELECT *, {_DIGITS} AS digits FROM e),
v AS (SELECT * FROM g WHERE CASE k WHEN 0 THEN true WHEN 1 THEN list_max([TRY_CAST(x AS HUGEINT) FOR x IN string_split(m, '.')]) <= 255 AND len([x FOR x IN string_split(m, '.') IF TRY_CAST(x AS HUGEINT) IS NULL]) = 0
  WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum([CASE WHEN j % 2 = 0 THEN CAST(digits[length(digits) - j] AS INT) ELSE CAST(digits[length(digits) - j] AS INT) * 2 - CASE WHEN CAST(digits[length(digits) - j] AS INT) > 4 THEN 9 ELSE 0 END END FOR j IN range(length(digits))]) % 10 = 0 ELSE length(digits) BETWEEN 9 AND 15 END),
a AS (SELECT id, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT), ',' ORDER BY s, k) AS spans, {", ".join(f"count(*) FILTER (k = {k}) AS n_{n}" for k, n in enumerate(("email", "ip", "card", "phone")))} FROM v GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in ("email", "ip", "card", "phone"))}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (id)"""
_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \x09-\x0D]+') AS words FROM d),
g AS (SELECT id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY id, gram) AS times FROM g) WHERE times > 1) GROUP BY id),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(t) - length(regexp_replace(t, '[^ \x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^ \x09-\x0D]')]) - len(list_distinct([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^ \x09-\x0D]')])) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""
_LENGTHS = """
WITH h AS (SELECT CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS length, count(*) AS n_docs FROM documents GROUP BY 1)
SELECT length, n_docs, CAST(sum(n_docs) OVER up AS BIGINT) AS docs_from, CAST(sum(n_docs * length) OVER up AS BIGINT) AS tokens_from, CAST(sum(n_docs * length) OVER () - sum(n_docs * length) OVER up + length * sum(n_docs) OVER up AS BIGINT) AS truncated_total,
  floor((sum(n_docs) OVER () - sum(n_docs) OVER up + n_docs) / sum(n_docs) OVER () * 1e6 + 0.5) / 1e6 AS quantile, CAST(sum(n_docs) OVER () AS BIGINT) AS total_docs, CAST(sum(n_docs * length) OVER () AS BIGINT) AS total_tokens FROM h WINDOW up AS (ORDER BY length DESC ROWS UNBOUNDED PRECEDING)"""


def oracle_sql() -> dict[str, str]:
    """SQL for whole results where it can say them, and for the parts of others that are queries of their own. What rests on models, sketches, hashes and tokens is tested against brute force, round trips and held-out rows."""
    return {
        "pii_base": _PII,
        "quality_counts": _QUALITY,
        "byte_length_sums": _LENGTHS,
        "op11_mixing": mixing.SQL,
        "op12_prefix_trie": prefix_trie.SQL,
        "op13_source_divergence": divergence.SQL,
        "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p),
r AS (SELECT *, payload_bytes >= 100 AND least IS NOT NULL AND page_id IS DISTINCT FROM least AS again FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to, CASE WHEN NOT again THEN true END AS verified FROM r"""
    }
