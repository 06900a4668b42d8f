"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, source_size * 3.0::DOUBLE AS lim, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (CAST(total AS DOUBLE) - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, total, coalesce(least(lim, weight * max(CASE WHEN level * weight < lim THEN level END) OVER ()), lim) AS target FROM l
), q AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.total,
         md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':1') AS h
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q
), c AS (
  SELECT u.*, k AS turn, CASE WHEN target > 0 THEN CAST(upto + k * source_size AS DOUBLE) / target ELSE 0 END AS finish
  FROM u, (SELECT unnest([0, 1, 2]) AS k)
), p AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, turn, h, doc_id ROWS UNBOUNDED PRECEDING) AS place FROM c
)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN place <= total THEN size ELSE 0 END) AS BIGINT) AS taken
FROM p GROUP BY doc_id, size, source_size, target
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3}
