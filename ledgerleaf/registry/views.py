"""SQL (DuckDB dialect) of the inputs, for the checks of the registered queries.

``sql(body, *views)`` puts the named views, and those they need, before a query.
"""

from __future__ import annotations

from ledgerleaf.functions.constants import DIMENSIONS, TYPE_KEYWORDS
from ledgerleaf.functions.text import WHITE_SPACE

MANIFEST = """
SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, substr(md5(source),1,16) AS company_id,
       filename, folder || filename AS relative_path, file_type,
       n_chars AS file_size_bytes,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(doc_id AS INT) AS uploaded_at,
       (doc_id % 5 <> 0) AS processed,
       CASE WHEN doc_id % 20 = 0 THEN 'Unsupported file type: .pptx' END AS processing_error,
       CAST(ceil(n_chars / 3000.0) AS INT) AS page_count, text
FROM (
  SELECT d.*, CASE doc_id % 12 WHEN 0 THEN 'Q1_2024_P&L' WHEN 1 THEN 'balance sheet 2024' WHEN 2 THEN 'Series A Pitch'
           WHEN 3 THEN 'Architecture_Overview' WHEN 4 THEN 'Cap Table' WHEN 5 THEN 'Terms_of_Service'
           WHEN 6 THEN 'Product_Roadmap' WHEN 7 THEN 'API documentation' WHEN 8 THEN 'notes'
           WHEN 9 THEN 'Investor Deck' WHEN 10 THEN 'user story backlog' ELSE 'scan' END
         || '_' || CAST(doc_id AS VARCHAR)
         || CASE doc_id % 10 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.PDF' WHEN 3 THEN '.docx' WHEN 4 THEN '.md'
              WHEN 5 THEN '.csv' WHEN 6 THEN '.txt' WHEN 7 THEN '.pptx' WHEN 8 THEN '.doc' ELSE '.xls' END AS filename,
         CASE doc_id % 10 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx' WHEN 4 THEN '.md'
              WHEN 5 THEN '.csv' WHEN 6 THEN '.txt' WHEN 7 THEN '.pptx' WHEN 8 THEN '.doc' ELSE '.xls' END AS file_type,
         CASE doc_id % 7 WHEN 0 THEN 'financials/' WHEN 1 THEN 'pitch_deck/' WHEN 2 THEN 'technical/' WHEN 3 THEN 'legal/'
              WHEN 4 THEN 'product/' WHEN 5 THEN 'misc/2024/' ELSE '' END AS folder
  FROM documents d) x
"""

COMPANIES = """
SELECT substr(md5(source),1,16) AS company_id, source AS name,
       CASE length(source) % 2 WHEN 0 THEN 'SaaS' ELSE 'FinTech' END AS industry,
       CASE min(doc_id) % 3 WHEN 0 THEN 'seed' WHEN 1 THEN 'series_a' ELSE 'growth' END AS stage,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(min(doc_id) AS INT) AS created_at
FROM documents GROUP BY source
"""

CELLS = """
SELECT 'stmt_' || CAST(s AS VARCHAR) AS document_id, substr(md5('s' || CAST(s % 20 AS VARCHAR)),1,16) AS company_id,
       0 AS table_index, r.row_index, q.col_index, r.row_label, q.period AS col_name,
       CASE r.row_index
         WHEN 0 THEN '$' || CAST(CAST(floor(cents / 100000) AS BIGINT) AS VARCHAR) || 'K'
         WHEN 1 THEN CAST(n % 90 AS VARCHAR) || '%'
         WHEN 2 THEN '(' || CAST(n AS VARCHAR) || ',000)'
         WHEN 3 THEN CAST(n * 3 AS VARCHAR) || '.5M'
         WHEN 4 THEN 'n/a'
         WHEN 5 THEN CAST(n AS VARCHAR)
         ELSE '€' || CAST(n AS VARCHAR) || 'k' END AS value
FROM (SELECT l_suppkey AS s, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS col_index,
             'Q' || CAST(quarter(l_shipdate) AS VARCHAR) || ' ' || CAST(year(l_shipdate) AS VARCHAR) AS period,
             sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n
      FROM lineitem GROUP BY 1, 2, 3) q
CROSS JOIN (VALUES (0,'Total Revenue'),(1,'Gross Margin'),(2,'Net income'),(3,'Cash balance'),
                   (4,'EBITDA margin'),(5,'Headcount (FTE)'),(6,'Monthly burn')) AS r(row_index, row_label)
UNION ALL
SELECT 'stmt_' || CAST(s_suppkey AS VARCHAR), substr(md5('s' || CAST(s_suppkey % 20 AS VARCHAR)),1,16), 0, 7, 1, 'Notes',
       'Comment', 'see annex'
FROM supplier
"""

STATEMENT_TEXT = """
SELECT 'ord_' || CAST(o_orderkey AS VARCHAR) AS document_id, substr(md5('s' || CAST(o_custkey % 20 AS VARCHAR)),1,16) AS company_id,
       'Update. Revenue: $' || CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR)
       || CASE o_orderkey % 4 WHEN 0 THEN 'K' WHEN 1 THEN ' M' WHEN 2 THEN 'b' ELSE '' END
       || '. Burn rate: 1,' || CAST(100 + o_orderkey % 900 AS VARCHAR) || '.5K; runway: ' || CAST(1 + o_orderkey % 24 AS VARCHAR)
       || CASE o_orderkey % 2 WHEN 0 THEN ' months' ELSE ' years' END
       || '. Gross margin: ' || CAST(o_orderkey % 100 AS VARCHAR) || '%. CAC: $' || CAST(50 + o_orderkey % 50 AS VARCHAR)
       || '. LTV ' || CAST(o_orderkey % 7 * 100 AS VARCHAR)
       || CASE WHEN o_orderkey % 5 = 0 THEN '. Cash on hand: 12,000. Sales: 7' ELSE '' END || '.' AS text
FROM orders
"""

MODEL_REPLIES = """
SELECT s_suppkey AS company_id, d.dimension, d.weight, d.ord, d.body,
       CASE WHEN (s_suppkey + d.ord) % 11 = 0 THEN 'no json here'
            WHEN s_suppkey % 2 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS reply
FROM (SELECT s.s_suppkey, v.*, '{"score": ' || CAST(CAST(floor((s.s_suppkey * 37 + v.ord * 53) % 101 / 10) AS BIGINT) AS VARCHAR)
             || '.' || CAST((s.s_suppkey * 37 + v.ord * 53) % 101 % 10 AS VARCHAR)
             || ', "reasoning": "r' || CAST(v.ord AS VARCHAR) || '", "key_findings": ["a' || CAST(v.ord AS VARCHAR) || '", "b", "c"]}' AS body
      FROM supplier s CROSS JOIN (VALUES ('market_opportunity',20,0),('competitive_moat',20,1),('team_quality',15,2),
        ('financial_health',15,3),('product_differentiation',15,4),('growth_potential',10,5),('risk_factors',5,6)) AS v(dimension, weight, ord)) d
"""

PAGE_TEXTS = """
SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS page,
       '# ' || role || ' ' || CAST(turn AS VARCHAR) || chr(10) || text AS text, CAST(turn % 3 AS INT) AS n_images,
       role || ' ' || CAST(turn AS VARCHAR) AS title
FROM conversations
"""

ANALYSES = """
SELECT CAST(s_suppkey AS VARCHAR) || '_' || CAST(run AS VARCHAR) AS analysis_id,
       substr(md5('src' || CAST(s_suppkey % 20 AS VARCHAR)), 1, 16) AS company_id,
       CASE (s_suppkey + run) % 5 WHEN 0 THEN 'strong_buy' WHEN 1 THEN 'buy' WHEN 2 THEN 'hold' WHEN 3 THEN 'pass' ELSE 'sell' END AS recommendation,
       round(abs(s_acctbal) / 1000, 2) AS overall_score,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(s_suppkey * 7 % 1000 * 60 + run AS INT) AS analyzed_at
FROM supplier CROSS JOIN (VALUES (0),(1)) AS r(run)
"""


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _best_type(scores: dict[str, str]) -> str:
    """(type, confidence) columns of the best score; ``scores`` are column names in tie order."""
    best = "greatest(" + ", ".join(scores.values()) + ")"
    whens = " ".join(f"WHEN {column} = {best} THEN '{name}'" for name, column in scores.items())
    return f"CASE WHEN {best} > 0 THEN CASE {whens} END ELSE 'other' END AS type, {best} AS confidence"


def _filename_scores() -> str:
    columns = []
    for name, spec in TYPE_KEYWORDS.items():
        parts = ["CAST(0 AS DOUBLE)"]
        for word in spec["keywords"]:
            parts.append(f"CASE WHEN contains(f, {_quote(word)}) THEN CAST(0.3 AS DOUBLE) ELSE 0 END")
            parts.append(f"CASE WHEN contains(p, {_quote(word)}) THEN CAST(0.2 AS DOUBLE) ELSE 0 END")
        extensions = ", ".join(_quote(e) for e in spec["extensions"])
        parts.append(f"CASE WHEN file_type IN ({extensions}) THEN CAST(0.1 AS DOUBLE) ELSE 0 END")
        columns.append(f"least({' + '.join(parts)}, CAST(1 AS DOUBLE)) AS s_{name}")
    return ",\n".join(columns)


def _content_scores() -> str:
    columns = []
    for name, spec in TYPE_KEYWORDS.items():
        hits = " + ".join(f"CAST(contains(t, {_quote(word)}) AS INT)" for word in spec["keywords"])
        columns.append(f"least(({hits}) * CAST(0.15 AS DOUBLE), CAST(1 AS DOUBLE)) AS s_{name}")
    return ",\n".join(columns)


_SCORES = {name: f"s_{name}" for name in TYPE_KEYWORDS}

FOLDER_SIGNAL = "SELECT doc_id, coalesce(t, 'other') AS type, CASE WHEN t IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence FROM (SELECT doc_id, CASE " + " ".join(
    f"WHEN contains(lower(relative_path), '{name}') OR contains(lower(relative_path), '{name.replace('_', ' ')}') THEN '{name}'"
    for name in TYPE_KEYWORDS
) + " END AS t FROM manifest)"

FILENAME_SIGNAL = (
    f"SELECT doc_id, {_best_type(_SCORES)} FROM (SELECT doc_id, {_filename_scores()} FROM "
    "(SELECT doc_id, file_type, lower(filename) AS f, lower(relative_path) AS p FROM manifest))"
)

CONTENT_SIGNAL = (
    f"SELECT doc_id, {_best_type(_SCORES)} FROM (SELECT doc_id, {_content_scores()} FROM "
    "(SELECT doc_id, lower(text) AS t FROM manifest))"
)

# Ballots as rows; equal sums fall to the earliest ballot of a type.
_BALLOTS = """
  SELECT doc_id, type, confidence * CAST(0.4 AS DOUBLE) AS v, 0 AS o FROM folder_signal WHERE confidence > 0.5
  UNION ALL SELECT doc_id, type, confidence * CAST(0.3 AS DOUBLE), 1 FROM filename_signal
"""
_VOTE = """
SELECT doc_id, type AS document_type, least(total, CAST(1 AS DOUBLE)) AS classification_confidence FROM (
  SELECT doc_id, type, total, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, o) AS rn FROM (
    SELECT doc_id, type, list_sum(list(v ORDER BY o)) AS total, min(o) AS o FROM ({ballots}) GROUP BY doc_id, type))
WHERE rn = 1
"""
VOTED = _VOTE.format(ballots=_BALLOTS)
VOTED_WITH_CONTENT = _VOTE.format(
    ballots=_BALLOTS
    + " UNION ALL SELECT c.doc_id, c.type, c.confidence * CAST(0.3 AS DOUBLE), 2 FROM content_signal c "
    "JOIN manifest m USING (doc_id) WHERE length(m.text) > 0"
)
CLASSIFIED = "SELECT m.*, v.document_type, v.classification_confidence FROM manifest m JOIN voted v USING (doc_id)"

BLANKS = "".join(f"chr({ord(c)}) || " for c in WHITE_SPACE)[: -len(" || ")]


def _chunk_end(start: str) -> str:
    window = f"substr(text, {start} + 701, least({start} + 900, n) - ({start} + 700) + 1)"
    finds = ", ".join(
        f"nullif(instr({window}, '{mark}' || {gap}), 0)" for mark in ".!?" for gap in ("' '", "chr(10)")
    )
    return f"CASE WHEN {start} + 800 < n THEN coalesce({start} + 700 + least({finds}), {start} + 800) ELSE {start} + 800 END"


def chunk_bounds(source: str) -> str:
    """Offsets of the chunks of ``source`` (``document_id, text``): ``document_id, chunk_index, s, e``."""
    return f"""
SELECT document_id, 0 AS chunk_index, 0 AS s, length(text) AS e, true AS whole FROM {source}
WHERE text IS NULL OR length(text) < 800
UNION ALL
SELECT document_id, chunk_index, s, e, false FROM (
WITH RECURSIVE walk AS (
  SELECT document_id, 0 AS chunk_index, CAST(0 AS BIGINT) AS s, CAST({_chunk_end('0')} AS BIGINT) AS e
  FROM (SELECT document_id, text, length(text) AS n FROM {source}) WHERE n >= 800
  UNION ALL
  SELECT document_id, chunk_index + 1, s, CAST({_chunk_end('s')} AS BIGINT)
  FROM (SELECT w.document_id, w.chunk_index, w.e - 200 AS s, d.text, length(d.text) AS n
        FROM walk w JOIN {source} d USING (document_id) WHERE w.e - 200 < length(d.text))
) SELECT * FROM walk)
"""


CHUNK_TEXTS = f"""
SELECT *, length(text) AS char_count FROM (
SELECT b.document_id, d.company_id, d.document_type, d.uploaded_at AS created_at, b.chunk_index, b.s AS chunk_start, b.whole,
       b.document_id || '_' || CAST(b.chunk_index AS VARCHAR) AS chunk_id,
       CASE WHEN b.whole THEN d.text ELSE trim(substr(d.text, b.s + 1, b.e - b.s), {BLANKS}) END AS text
FROM bounds b JOIN classified d USING (document_id)) WHERE whole OR length(text) > 0
"""

FULL_PAGES = """
SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, CAST(count(*) AS INT) AS page_count,
       max(n_images) > 0 AS has_charts
FROM page_texts GROUP BY document_id
"""

PAGE_STARTS = """
SELECT document_id, page, title,
       coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
FROM page_texts
"""

LETTERS = "[" + ", ".join(
    f"CAST(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{c}', '')) AS DOUBLE)"
    for c in "abcdefghijklmnopqrstuvwxyz"
) + "]"

DIMENSION_QUESTIONS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', {i}, {spec['weight']}, {q}, {_quote(text)})"
    for i, (name, spec) in enumerate(DIMENSIONS.items())
    for q, text in enumerate(spec["questions"])
) + ") AS v(dimension, ord, weight, question_number, question)"

_PARSE_AMOUNT_BARE = "replace(regexp_replace(trim(value), '[$€£,)]', '', 'g'), '(', '-')"
_FLOAT = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$'"
AMOUNT = f"""CASE
  WHEN contains({_PARSE_AMOUNT_BARE}, '%') THEN TRY_CAST(replace({_PARSE_AMOUNT_BARE}, '%', '') AS DOUBLE) / 100
  WHEN regexp_matches(regexp_replace({_PARSE_AMOUNT_BARE}, '[KkMmBb]$', ''), {_FLOAT})
  THEN CAST(regexp_replace({_PARSE_AMOUNT_BARE}, '[KkMmBb]$', '') AS DOUBLE)
    * CASE upper(right({_PARSE_AMOUNT_BARE}, 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1e0 END
END"""

_PERIOD = "'(?i)Q[1-4]\\s*\\d{4}|FY\\s*\\d{2,4}|\\d{4}|(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s*\\d{4}|YTD|TTM'"
IS_PERIOD = f"regexp_matches(col_name, {_PERIOD})"

METRIC_OF_LABEL = """CASE
  WHEN regexp_matches(lower(row_label), 'revenue|sales|top line|arr|mrr') THEN 'revenue'
  WHEN regexp_matches(lower(row_label), 'gross margin|gross profit margin|gp margin') THEN 'gross_margin'
  WHEN regexp_matches(lower(row_label), 'operating margin|ebitda margin') THEN 'operating_margin'
  WHEN regexp_matches(lower(row_label), 'net income|net profit|bottom line|earnings') THEN 'net_income'
  WHEN contains(lower(row_label), 'ebitda') THEN 'ebitda'
  WHEN contains(lower(row_label), 'cash') THEN 'cash_balance'
  WHEN regexp_matches(lower(row_label), 'burn rate|monthly burn|cash burn') THEN 'burn_rate'
  WHEN regexp_matches(lower(row_label), 'headcount|employees|team size|fte') THEN 'headcount'
  WHEN regexp_matches(lower(row_label), 'active users|mau|dau|users') THEN 'active_users' END"""

TABLE_METRICS = f"""
SELECT document_id || '_' || CAST(table_index AS VARCHAR) || '_' || CAST(row_index AS VARCHAR) || '_' || CAST(col_index AS VARCHAR) || '_' || col_name AS metric_id,
       company_id, document_id, col_name AS period, metric_name, value, CAST(0.8 AS DOUBLE) AS confidence_score
FROM (SELECT document_id, company_id, table_index, row_index, col_index, col_name, {METRIC_OF_LABEL} AS metric_name, {AMOUNT} AS value
      FROM cells WHERE {IS_PERIOD})
WHERE metric_name IS NOT NULL AND value IS NOT NULL
"""


def _text_metric(name: str, column: str, names: str, number: str, after: str) -> str:
    # RE2 has no look-ahead: the letters behind the number are captured whole and then tested.
    pattern = f"'(?i)(?:{names})[\\s:]+{number}{after}'"
    return f"""SELECT company_id, document_id, '{name}' AS name, '{column}' AS metric_name,
      unnest(range(len(regexp_extract_all(text, {pattern}, 1)))) AS ordinal,
      unnest(regexp_extract_all(text, {pattern}, 1)) AS number,
      upper(unnest(regexp_extract_all(text, {pattern}, 2))) AS behind FROM statement_text"""


_MONEY = r"\$?([\d,]+(?:\.\d+)?)"
_PLAIN = r"(\d+(?:\.\d+)?)"
TEXT_MATCHES = "\nUNION ALL ".join(
    [
        _text_metric("revenue", "revenue", r"revenue|sales|top\s+line", _MONEY, r"(?:\s*([A-Z]+))?"),
        _text_metric("burn_rate", "burn_rate", r"burn\s+rate|monthly\s+burn", _MONEY, r"(?:\s*([A-Z]+))?"),
        _text_metric("runway", "runway_months", "runway", _PLAIN, r"\s*(months?|years?)"),
        _text_metric("cash", "cash_balance", r"cash\s+balance|cash\s+on\s+hand", _MONEY, r"(?:\s*([A-Z]+))?"),
        _text_metric("gross_margin", "gross_margin", r"gross\s+margin", _PLAIN, r"\s*(%)"),
        _text_metric("cac", "cac", r"CAC|customer\s+acquisition\s+cost", _MONEY, r"(?:\s*([A-Z]+))?"),
        _text_metric("ltv", "ltv", r"LTV|lifetime\s+value", _MONEY, r"(?:\s*([A-Z]+))?"),
    ]
)

TEXT_METRICS = """
SELECT document_id || '_' || name || '_' || CAST(ordinal AS VARCHAR) AS metric_id, company_id, document_id,
       CAST(NULL AS VARCHAR) AS period, metric_name,
       CAST(replace(number, ',', '') AS DOUBLE)
       * CASE WHEN behind = 'K' THEN 1e3 WHEN behind = 'M' THEN 1e6 WHEN behind = 'B' THEN 1e9
              WHEN behind LIKE 'YEAR%' THEN 12e0 ELSE 1e0 END
       / CASE WHEN behind = '%' THEN 100e0 ELSE 1e0 END AS value,
       CAST(0.6 AS DOUBLE) AS confidence_score
FROM text_matches
"""

METRICS_LONG = "SELECT * FROM table_metrics UNION ALL SELECT * FROM text_metrics"

_METRICS = (
    "revenue", "revenue_growth_rate", "recurring_revenue", "gross_margin", "operating_margin", "net_income", "ebitda",
    "cash_balance", "burn_rate", "runway_months", "cac", "ltv", "ltv_cac_ratio", "headcount", "active_users",
)
METRICS_WIDE = "SELECT metric_id, company_id, document_id, period AS period_start, period AS period_end, confidence_score, " + ", ".join(
    f"CASE WHEN metric_name = '{name}' THEN value END AS {name}" for name in _METRICS
) + " FROM metrics_long"

PERIOD_PROFILE = "SELECT company_id, period, " + ", ".join(
    f"max(CASE WHEN metric_name = '{name}' THEN value END) AS {name}" for name in _METRICS
) + " FROM metrics_long GROUP BY company_id, period"

PROFILE = """
SELECT company_id, avg(revenue) AS revenue, avg(revenue_growth_rate) AS revenue_growth_rate, avg(gross_margin) AS gross_margin,
       avg(burn_rate) AS burn_rate, avg(runway_months) AS runway_months, avg(cac) AS cac, avg(ltv) AS ltv,
       avg(ltv_cac_ratio) AS ltv_cac_ratio, max(headcount) AS headcount
FROM metrics_wide GROUP BY company_id
"""

DIMENSIONS_PARSED = """
SELECT company_id, dimension, weight, ord,
       CASE WHEN reply = 'no json here' THEN 5e0 ELSE CAST(json_extract_string(body, '$.score') AS DOUBLE) END AS score,
       CASE WHEN reply = 'no json here' THEN 'Unable to fully analyze this dimension.' ELSE json_extract_string(body, '$.reasoning') END AS reasoning,
       CASE WHEN reply = 'no json here' THEN [] ELSE CAST(json_extract(body, '$.key_findings') AS VARCHAR[]) END AS key_findings
FROM model_replies
"""

SCORES = """
SELECT company_id, round(sum(score * weight) / 100, 9) AS overall_score,
       greatest(0e0, least(1e0, 1 - var_pop(score) / 25)) AS confidence_level,
       max(CASE WHEN dimension = 'market_opportunity' THEN reasoning END) AS market_analysis,
       max(CASE WHEN dimension = 'competitive_moat' THEN reasoning END) AS competitive_moat,
       max(CASE WHEN dimension = 'team_quality' THEN reasoning END) AS team_assessment,
       max(CASE WHEN dimension = 'risk_factors' THEN array_to_string(key_findings, '|') END) AS key_risks
FROM dimensions_parsed GROUP BY company_id
"""

SCORED = """
SELECT *, CASE WHEN overall_score >= 8 THEN 'strong_buy' WHEN overall_score >= 7 THEN 'buy' WHEN overall_score >= 5 THEN 'hold' ELSE 'pass' END AS recommendation
FROM scores
"""

OPPORTUNITIES = """
SELECT company_id, array_to_string(list(f ORDER BY ord, i)[1:5], '|') AS key_opportunities
FROM (SELECT company_id, ord, unnest(key_findings[1:2]) AS f, unnest(range(least(len(key_findings), 2))) AS i
      FROM dimensions_parsed WHERE score >= 7) GROUP BY company_id
"""

NEXT_STEPS = """
SELECT s.company_id, array_to_string((CASE
  WHEN recommendation IN ('strong_buy', 'buy') THEN list_concat(list_concat(
      ['Schedule founder meeting for deep dive', 'Request detailed financial model and projections'],
      coalesce(weak, [])), ['Prepare term sheet and valuation analysis'])
  WHEN recommendation = 'hold' THEN ['Request additional information on key concerns', 'Schedule follow-up in 3-6 months']
  ELSE ['Send polite pass email to founders'] END)[1:5], '|') AS next_steps
FROM scored s LEFT JOIN (
  SELECT company_id, list('Conduct additional diligence on ' || replace(dimension, '_', ' ') ORDER BY ord) AS weak
  FROM dimensions_parsed WHERE score < 6 GROUP BY company_id) w USING (company_id)
"""

NARRATIVE = """
SELECT company_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '. ') || '.' ELSE 'Limited financial data available.' END AS financial_analysis
FROM (SELECT company_id, list_filter([
  CASE WHEN revenue <> 0 THEN 'Revenue: $' || format('{:,.0f}', revenue) END,
  CASE WHEN revenue_growth_rate <> 0 THEN 'Growth rate: ' || format('{:.1f}', revenue_growth_rate * 100) || '%' END,
  CASE WHEN burn_rate <> 0 AND runway_months <> 0 THEN 'Burn rate: $' || format('{:,.0f}', burn_rate) || '/month. Runway: ' || format('{:.1f}', runway_months) || ' months' END,
  CASE WHEN ltv_cac_ratio <> 0 THEN 'LTV/CAC: ' || format('{:.1f}', ltv_cac_ratio) || 'x' END], lambda x: x IS NOT NULL) AS parts
FROM (SELECT * REPLACE (revenue / 1e6 AS revenue) FROM profile))
"""

# View: (SQL, views it needs).
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "manifest": (MANIFEST, ()),
    "companies": (COMPANIES, ()),
    "cells": (CELLS, ()),
    "statement_text": (STATEMENT_TEXT, ()),
    "model_replies": (MODEL_REPLIES, ()),
    "page_texts": (PAGE_TEXTS, ()),
    "analyses": (ANALYSES, ()),
    "folder_signal": (FOLDER_SIGNAL, ("manifest",)),
    "filename_signal": (FILENAME_SIGNAL, ("manifest",)),
    "content_signal": (CONTENT_SIGNAL, ("manifest",)),
    "voted": (VOTED, ("folder_signal", "filename_signal")),
    "voted_with_content": (VOTED_WITH_CONTENT, ("folder_signal", "filename_signal", "content_signal")),
    "classified": (CLASSIFIED, ("manifest", "voted")),
    "bounds": (chunk_bounds("manifest"), ("manifest",)),
    "chunk_texts": (CHUNK_TEXTS, ("bounds", "classified")),
    "full_pages": (FULL_PAGES, ("page_texts",)),
    "page_starts": (PAGE_STARTS, ("page_texts",)),
    "page_bounds": (chunk_bounds("full_pages"), ("full_pages",)),
    "dimension_questions": (DIMENSION_QUESTIONS, ()),
    "table_metrics": (TABLE_METRICS, ("cells",)),
    "text_matches": (TEXT_MATCHES, ("statement_text",)),
    "text_metrics": (TEXT_METRICS, ("text_matches",)),
    "metrics_long": (METRICS_LONG, ("table_metrics", "text_metrics")),
    "metrics_wide": (METRICS_WIDE, ("metrics_long",)),
    "period_profile": (PERIOD_PROFILE, ("metrics_long",)),
    "profile": (PROFILE, ("metrics_wide",)),
    "dimensions_parsed": (DIMENSIONS_PARSED, ("model_replies",)),
    "scores": (SCORES, ("dimensions_parsed",)),
    "scored": (SCORED, ("scores",)),
    "opportunities": (OPPORTUNITIES, ("dimensions_parsed",)),
    "next_steps_of": (NEXT_STEPS, ("scored", "dimensions_parsed")),
    "narrative": (NARRATIVE, ("profile",)),
}


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """A query with the views it names, and those they need, in front of it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({VIEWS[name][0]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body
