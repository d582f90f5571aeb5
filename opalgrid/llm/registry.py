"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express.

Some results are fixed by SQL in part: for these there is a query more, which takes the columns that are so from the operator's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import exact_dedup, html, imatch, licenses, mixing, near_dup, packing, pii, quality, warc


def imatch_edits(spark, sf_dir: str) -> DataFrame:
    """What ``op2_imatch`` says of texts and edited texts, without fingerprints."""
    return imatch.op2_imatch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def pii_base_counts(spark, sf_dir: str) -> DataFrame:
    """The numbers of base spans in ``op6_pii``."""
    return pii.op6_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.KINDS])


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """Sizes and targets in ``op10_mixing``."""
    return mixing.op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def queries() -> dict:
    return {
        "op1_warc_index": warc.op1_warc_index,
        "op2_imatch": imatch.op2_imatch,
        "op3_licenses": licenses.op3_licenses,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_quality": quality.op5_quality,
        "op6_pii": pii.op6_pii,
        "op7_packing": packing.op7_packing,
        "op8_html_text": html.op8_html_text,
        "op9_near_duplicates": near_dup.op9_near_duplicates,
        "op10_mixing": mixing.op10_mixing,
        "imatch_edits": imatch_edits,
        "pii_base_counts": pii_base_counts,
        "mixing_targets": mixing_targets,
    }


IMATCH_EDITS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     e AS (SELECT doc_id, t, length(t) AS n, CASE WHEN lead(doc_id) OVER o IS NULL THEN first_value(t) OVER o ELSE lead(t) OVER o END AS following FROM d WINDOW o AS (ORDER BY doc_id))
SELECT doc_id, n AS n_chars, sha256(substring(t, 1, n - n // 2) || substring(following, 1, n // 2)) AS edited_sha256 FROM e
"""

PII_BASE_COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
           [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')] AS card, [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')] AS phone FROM d)
SELECT doc_id, len(email) AS n_email,
       len([x FOR x IN ip IF list_max([CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(p, '0') AS INT) END FOR p IN string_split(x, '.')]) <= 255]) AS n_ip,
       len([x FOR x IN card IF length(x) BETWEEN 12 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN CAST(substr(x, length(x) - i, 1) AS INT) ELSE (2 * CAST(substr(x, length(x) - i, 1) AS INT)) // 10 + (2 * CAST(substr(x, length(x) - i, 1) AS INT)) % 10 END FOR i IN range(length(x))]) % 10 = 0]) AS n_card,
       len([x FOR x IN phone IF length(x) BETWEEN 9 AND 15]) AS n_phone
FROM m
"""

MIXING_TARGETS = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
     r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
     -- sources stop at their limit in the order of size by weight: what the first k - 1 leave, and the weight of the others
     k AS (SELECT *, row_number() OVER (ORDER BY size / weight, source NULLS LAST) AS k FROM r),
     c AS (SELECT *, CAST((SELECT sum(size) FROM s) - 3 * coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS unit FROM k),
     u AS (SELECT unit FROM c WHERE unit * weight <= 3 * size ORDER BY k LIMIT 1)
SELECT d.doc_id, d.size, r.size AS source_size, CASE WHEN u.unit * r.weight > 3 * r.size THEN CAST(3 * r.size AS DOUBLE) ELSE u.unit * r.weight END AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, u
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_index": warc.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op9_near_duplicates": near_dup.ORACLE,
        "imatch_edits": IMATCH_EDITS,
        "pii_base_counts": PII_BASE_COUNTS,
        "mixing_targets": MIXING_TARGETS,
    }
