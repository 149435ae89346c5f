"""The model tables of ``foliomill.sources.derive`` as SQL common table expressions."""

LINES = r"""
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
lines AS (SELECT doc_id, n // 45 AS page, n % 45 AS line_no, line FROM l0)
"""

PIECES = LINES + r""",
p0 AS (SELECT doc_id, page, line_no, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) - 1 AS piece_no FROM lines),
p1 AS (SELECT *, length(w) AS n, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, page, line_no ORDER BY piece_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p0),
p2 AS (SELECT *, CASE WHEN n % 7 = 0 THEN 12.0::DOUBLE ELSE 20.0 END AS size, CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS flag,
       96.0::DOUBLE + 14.0 * line_no - CASE WHEN n % 11 = 0 THEN 3.0 ELSE 0.0 END AS base, 72.0::DOUBLE + 6.0 * b AS x0 FROM p1),
pieces AS (SELECT doc_id, page, line_no, piece_no, w || ' ' AS text, 'F' || flag AS font, 5 + flag AS font_object, size, base, x0, x0 + 6.0 * n AS x1,
           round(base - 0.8 * size, 2) AS y0, round(base + 0.2 * size, 2) AS y1 FROM p2)
"""

SPANS = PIECES + r""",
s0 AS (SELECT *, lag(font) OVER w AS pf, lag(size) OVER w AS ps, lag(base) OVER w AS pb, lag(x1) OVER w AS px FROM pieces WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY piece_no)),
s1 AS (SELECT *, CASE WHEN pf = font AND abs(ps - size) <= 0.1 AND abs(pb - base) <= 0.6 AND x0 - px BETWEEN -1.0 AND size * 0.35 THEN 0 ELSE 1 END AS brk FROM s0),
s2 AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page, line_no ORDER BY piece_no ROWS UNBOUNDED PRECEDING) AS grp FROM s1),
s3 AS (SELECT doc_id, page, line_no, grp, string_agg(text, '' ORDER BY piece_no) AS text, min_by(font, piece_no) AS font, min_by(font_object, piece_no) AS font_object, min_by(size, piece_no) AS size,
       min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min_by(base, piece_no) AS base, count(*) AS n_fragments FROM s2 GROUP BY ALL),
spans AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no, grp) - 1 AS ordinal FROM s3 WHERE length(regexp_replace(text, '\s', '', 'g')) > 0)
"""

ART = r"""
a0 AS (SELECT DISTINCT doc_id, page FROM lines),
art AS (SELECT doc_id, page, 300.0::DOUBLE AS x0, 80.0::DOUBLE + 14.0 * line_no AS y0, 310.0::DOUBLE AS x1, 100.0::DOUBLE + 14.0 * line_no AS y1 FROM lines WHERE line_no % 10 = 0
        UNION ALL SELECT doc_id, page, 560.0, 0.0, 561.0, 842.0 FROM a0)
"""

EVENTS = r"ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) AS us FROM events)"

EDITS = EVENTS + r""",
nd AS (SELECT count(*) AS n FROM documents),
e0 AS (SELECT *, event_id % (SELECT n FROM nd) AS doc_id, CASE WHEN event_type IN ('view', 'click') THEN 'replace' WHEN event_type = 'purchase' THEN 'redact' WHEN event_type = 'signup' THEN 'insert'
       WHEN k % 2 = 0 THEN 'rotate' ELSE 'delete_page' END AS kind FROM ev),
edits AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) AS position, kind, CASE WHEN kind IN ('replace', 'redact') THEN user_id % 20 END AS span_ordinal,
          CASE WHEN kind = 'delete_page' THEN k % 3 WHEN kind IN ('rotate', 'insert') THEN 0 END AS page,
          CASE WHEN kind = 'replace' THEN 'text ' || (k % 5) WHEN kind = 'insert' THEN CASE WHEN k % 7 = 0 THEN '' ELSE 'new ' || k END END AS text,
          CASE WHEN kind = 'redact' THEN k % 10 END AS start, CASE WHEN kind = 'redact' THEN k % 10 + 5 END AS stop, CASE WHEN kind = 'rotate' THEN 90 END AS degrees FROM e0)
"""

OPENS = EVENTS + r", opens AS (SELECT user_id AS account, sha256(k::VARCHAR) AS digest, event_id, us FROM ev WHERE event_type = 'view')"

BILLING = EVENTS + r""",
billing AS (SELECT event_id // 2 AS id, event_id AS arrival, CASE WHEN user_id % 10 <> 0 THEN user_id END AS account, us AS created, us // 1000000 + 2592000 AS paid_until,
            us // 1000 + (event_id % 13 - 6) * 3600000 AS paid_read_at, CASE WHEN k % 4 = 0 THEN 'other' ELSE 'invoice.paid' END AS type FROM ev WHERE event_type = 'purchase')
"""

REQUESTS = EVENTS + r""",
requests AS (SELECT event_id AS request, user_id AS key, '/r' || (k % 5) AS route, CASE WHEN k % 17 = 0 THEN 500 WHEN k % 19 = 0 THEN 499 ELSE 200 END AS status, floor(value)::BIGINT AS ms, us, k FROM ev WHERE event_type = 'click')
"""

TOKENS = EVENTS + r", tokens AS (SELECT user_id AS account, us // 1000000 + 900 - (event_id % 4) * 600 AS until, us // 1000000 AS used_at, event_id AS arrival FROM ev WHERE event_type = 'signup')"

MAIL = EVENTS + r""",
mail AS (SELECT CASE WHEN event_type = 'signup' THEN 'invite' WHEN value > 20 THEN 'hard_bounce' ELSE 'other' END AS event, 'u' || user_id || '@mail.example' AS email, us, event_id FROM ev WHERE event_type IN ('error', 'signup'))
"""

INVOICES = EVENTS + r""",
i0 AS (SELECT *, event_id % 4 AS style, floor(value)::BIGINT::VARCHAR || '.' || lpad((k % 100)::VARCHAR, 2, '0') AS money, lpad(k::VARCHAR, 3, '0') AS mills FROM ev),
inv AS (SELECT *, event_id AS doc_id, 's' || (user_id % 3) AS source,
  CASE style WHEN 0 THEN strftime(ts, '%d/%m/%Y') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%m/%d/%Y') ELSE strftime(ts, '%-d %B %Y') END AS day,
  CASE style WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'KWD' END AS currency,
  CASE style WHEN 0 THEN '$' || money WHEN 1 THEN replace(money, '.', ',') || ' €' WHEN 2 THEN '(£' || money || ')' ELSE 'KWD 1.' || mills END AS paid,
  CASE style WHEN 2 THEN -money::DOUBLE WHEN 3 THEN ('1.' || mills)::DOUBLE ELSE money::DOUBLE END AS amount FROM i0),
inv_dates AS (SELECT doc_id, source, day AS written, ts::DATE AS date FROM inv WHERE style < 3 UNION ALL SELECT doc_id, source, CASE style WHEN 0 THEN '25/12/2024' ELSE '12/25/2024' END, DATE '2024-12-25' FROM inv WHERE style IN (0, 2))
"""

HIDDEN = r"""
copies AS (SELECT page_id AS doc_id, 'title' AS place, unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)) AS text FROM pages
  UNION ALL SELECT page_id, 'metadata', unnest(regexp_extract_all(html, '<meta ([^>]*)>', 1)) FROM pages
  UNION ALL SELECT page_id, 'comments', unnest(regexp_extract_all(html, '<!--([^>]*)-->', 1)) FROM pages)
"""
