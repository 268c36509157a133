"""DuckDB statements for the queries that SQL can express over whole tables."""

_CELLS = """
  SELECT DISTINCT row_idx, outlet_clean, year, on_topic_flag FROM check_strata
  WHERE row_idx IS NOT NULL AND outlet_clean IS NOT NULL AND year IS NOT NULL AND on_topic_flag IS NOT NULL"""

_LINES = r"""
  kept AS (SELECT row_idx, outlet_clean, string_split(body, chr(10)) AS lines FROM preprocess_final
           WHERE outlet_clean IS NOT NULL AND length(body) > 0),
  each AS (SELECT row_idx, outlet_clean, CAST(i - 1 AS INTEGER) AS line_no,
             regexp_replace(regexp_replace(lower(lines[i]), '[\s\x0B\x{85}\pZ\x{200B}\x{2060}\x{FEFF}\x1C-\x1F]+', '', 'g'), '\p{Nd}+', '0', 'g') AS line
           FROM kept, unnest(range(1, len(lines) + 1)) AS r(i)),
  real AS (SELECT * FROM each WHERE regexp_matches(line, '\pL')),
  n AS (SELECT outlet_clean, count(*) AS docs FROM kept GROUP BY ALL),
  often AS (SELECT outlet_clean, line FROM real JOIN n USING (outlet_clean) GROUP BY outlet_clean, line, docs
            HAVING count(DISTINCT row_idx) >= 8 AND count(DISTINCT row_idx) * 20 >= docs)"""

_COPIES = r"""
WITH k AS (
  SELECT row_idx, ingested_at, regexp_replace(lower(nfc_normalize(coalesce(title, ''))), '[^\pL\pM\pN]+', '', 'g') AS t, split_part(body, chr(10), 1) AS first_line, body
  FROM (SELECT * REPLACE (nfc_normalize(body) AS body) FROM preprocess_final WHERE length(body) > 0)),
c AS (
  SELECT row_idx, ingested_at, t, CASE WHEN regexp_matches(body, '^\s*\pL[\pL\pN_-]*\s*:[^\n]*[^\n\pL\pN_-]\pL[\pL\pN_-]*\s*:[^\n]*\n') THEN
    array_to_string(list_sort(list_filter(list_transform(string_split(regexp_replace(first_line, '(^|[^\pL\pN_-])(\pL[\pL\pN_-]*\s*:)', '\1' || chr(1) || '\2', 'g'), chr(1)),
      lambda x: regexp_replace(lower(x), '[^\pL\pM\pN]+', '', 'g')), lambda x: x <> '')), chr(1)) || chr(2) || regexp_replace(lower(substr(body, length(first_line) + 1)), '[^\pL\pM\pN]+', '', 'g')
    ELSE regexp_replace(lower(body), '[^\pL\pM\pN]+', '', 'g') END AS b FROM k)"""

ORACLES = {
    "p1_blocks": f"""WITH RECURSIVE {_LINES},
  step AS (SELECT outlet_clean, row_idx, line AS a, lead(line) OVER (PARTITION BY row_idx ORDER BY line_no) AS b FROM real),
  edges AS (SELECT s.outlet_clean, a, b FROM step s JOIN n USING (outlet_clean) JOIN often x ON x.outlet_clean = s.outlet_clean AND x.line = a JOIN often y ON y.outlet_clean = s.outlet_clean AND y.line = b
            GROUP BY s.outlet_clean, a, b, docs HAVING count(DISTINCT row_idx) >= 8 AND count(DISTINCT row_idx) * 20 >= docs),
  twoway AS (SELECT * FROM edges UNION SELECT outlet_clean, b, a FROM edges),
  reach AS (SELECT outlet_clean, line, line AS root FROM often UNION SELECT r.outlet_clean, b, root FROM reach r JOIN twoway e ON e.outlet_clean = r.outlet_clean AND e.a = r.line),
  block AS (SELECT outlet_clean, line, min(root) AS block FROM reach GROUP BY ALL),
  support AS (SELECT outlet_clean, line, count(DISTINCT row_idx) AS support FROM real GROUP BY ALL)
SELECT outlet_clean, CAST(count(*) AS BIGINT) AS block_lines, max(support) AS max_support, min(support) AS min_support FROM block JOIN support USING (outlet_clean, line) GROUP BY outlet_clean, block""",
    "p1_clean": f"""WITH {_LINES},
  gone AS (SELECT row_idx, line_no FROM real JOIN often USING (outlet_clean, line)),
  rest AS (SELECT e.row_idx, string_agg(lines[line_no + 1], chr(10) ORDER BY line_no) AS body FROM each e JOIN kept USING (row_idx) ANTI JOIN gone g ON g.row_idx = e.row_idx AND g.line_no = e.line_no GROUP BY ALL),
  out AS (SELECT row_idx, count(*) AS removed FROM gone GROUP BY ALL)
SELECT p.row_idx, CASE WHEN removed IS NULL THEN p.body ELSE coalesce(k.body, '') END AS body, CAST(coalesce(removed, 0) AS INTEGER) AS lines_removed
FROM preprocess_final p LEFT JOIN out o USING (row_idx) LEFT JOIN rest k USING (row_idx)""",
    "p1_found": f"WITH {_LINES} SELECT row_idx, line_no FROM real JOIN often USING (outlet_clean, line)",
    "p2_found": f"""
WITH cells AS ({_CELLS}),
  n AS (SELECT count(DISTINCT row_idx) // 10 AS size FROM cells),
  pool AS (SELECT outlet_clean, year, on_topic_flag, count(*) AS pool FROM cells GROUP BY ALL)
SELECT t.outlet_clean, t.year, CAST(t.on_topic_flag AS INTEGER) AS on_topic
FROM strata_targets t LEFT JOIN pool p USING (outlet_clean, year, on_topic_flag), n
WHERE coalesce(pool, 0) < t.min_rows OR coalesce(pool, 0) < t.target_share * n.size""",
    "p5_found": _COPIES + """
SELECT x.row_idx AS row_idx_a, y.row_idx AS row_idx_b FROM c x JOIN c y ON x.t = y.t AND x.b = y.b AND x.row_idx < y.row_idx""",
    "p5_ledger": _COPIES + """
SELECT arg_min(row_idx, struct_pack(late := ingested_at IS NULL, at := ingested_at, id := row_idx)) AS row_idx, CAST(count(*) AS BIGINT) AS copies, min(ingested_at) AS first_ingested_at FROM c GROUP BY t, b""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
