"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WS = r"[^\x20\x09-\x0D]+"

#: Of equal rows of documents, DuckDB and the operator may give the slots in another order.
OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WS}'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sized GROUP BY source),
level AS (
  SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / w AS ratio,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM per),
water AS (SELECT *, arg_min(lv, ratio) FILTER (lv < ratio) OVER () AS wl FROM level),
targets AS (SELECT source, source_size, CASE WHEN wl IS NULL THEN cap ELSE least(cap, wl * w) END AS target FROM water),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT doc_id, source, start, size, source_size, target,
    (sum(greatest(0, least(size, floor(target) - e * source_size - start))))::BIGINT AS taken
  FROM placed, (VALUES (0), (1), (2)) AS epochs(e) GROUP BY doc_id, source, start, size, source_size, target),
need AS (
  SELECT source, sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS hi,
    (sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) - target) / sum(target) OVER () AS lo,
    (floor(floor(target) / greatest(source_size, 1)) * ceil(source_size / 4096.0)
     + ceil((floor(target) - floor(floor(target) / greatest(source_size, 1)) * greatest(source_size, 1)) / 4096.0))::BIGINT AS slots FROM targets),
points AS (SELECT i AS slot, (i * 2654435769 % 4294967296) / 4294967296.0::DOUBLE AS x FROM range((SELECT sum(slots)::BIGINT FROM need)) r(i)),
hits AS (SELECT source, slot, slots, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN need ON x >= lo AND x < hi AND slots > 0),
got AS (SELECT n.source, n.slots, count(h.slot) AS got FROM need n LEFT JOIN hits h ON n.source IS NOT DISTINCT FROM h.source GROUP BY ALL),
late AS (SELECT source, unnest(range(got, slots)) AS rank FROM got WHERE got < slots),
filled AS (
  SELECT source, rank, slot FROM hits WHERE rank < slots
  UNION ALL SELECT source, rank, (SELECT sum(slots) FROM need)::BIGINT + row_number() OVER (ORDER BY source NULLS LAST, rank) - 1 FROM late)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM taken t LEFT JOIN filled f ON t.source IS NOT DISTINCT FROM f.source AND f.rank = t.start // 4096
"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
_KINDS = ((0, _ASSIGN, 2), (1, "AKIA[A-Z0-9]{16,}", 0), (2, "[0-9a-f]{24,}", 0), (3, "[A-Za-z0-9+/_-]{20,}", 0))

OP6 = (
    """
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ("""
    + " UNION ALL ".join(
        f"SELECT uid, doc_id, source, {k} AS kind, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {g}) AS v, string_split_regex(text, '{p}') AS gaps FROM docs"
        for k, p, g in _KINDS
    )
    + """),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
placed AS (
  SELECT uid, doc_id, source, kind, v[i] AS value, length(m[i]) AS size,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM each),
known AS (
  SELECT *, start + size AS stop FROM placed
  WHERE kind IN (1, 2) OR (kind = 0 AND length(value) >= 6)
    OR (kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10)),
owners AS (
  SELECT value, count(DISTINCT coalesce('s' || source, 'null')) <= 2 AND count(DISTINCT uid) <= 8 AS live FROM known GROUP BY value),
judged AS (SELECT k.*, live FROM known k JOIN owners USING (value)),
spans AS (
  SELECT uid, kind, start, stop, live FROM judged WHERE kind < 3
  UNION ALL SELECT uid, kind, start, stop, live FROM judged j
  WHERE kind = 3 AND live AND NOT EXISTS (FROM judged b WHERE b.uid = j.uid AND b.kind < 3 AND b.start <= j.start AND b.stop >= j.stop)),
said AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS span FROM spans)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind, stop) FILTER (kind IS NOT NULL), '') AS spans,
  count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
FROM docs d LEFT JOIN said s USING (uid) GROUP BY uid
"""
)

OP7 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, ''))::BIGINT AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP10 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok', NULL
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', NULL),
sized AS (SELECT *, 32 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM rows_),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS chars,
    lead(1) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) IS NULL AS is_last FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR is_last THEN chars ELSE 0 END)::BIGINT AS formatted_chars
FROM upto GROUP BY conv_id, alone
"""


def oracle_sql() -> dict:
    return {"op1_mixing": OP1, "op6_secrets": OP6, "op7_exact": OP7, "op10_chat": OP10}
