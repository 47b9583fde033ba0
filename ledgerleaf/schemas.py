"""Table schemas: fixed values of the data model. Fractions are DOUBLE throughout, lists are arrays."""

from __future__ import annotations

COMPANIES = """
    company_id STRING NOT NULL, name STRING NOT NULL, industry STRING, stage STRING, founded_year INT,
    headquarters STRING, website STRING, created_at TIMESTAMP, updated_at TIMESTAMP, total_documents INT,
    last_analyzed TIMESTAMP
"""

DOCUMENTS = """
    document_id STRING NOT NULL, company_id STRING NOT NULL, filename STRING NOT NULL, file_path STRING NOT NULL,
    relative_path STRING, source_url STRING, file_type STRING, file_size_bytes BIGINT, document_type STRING,
    classification_confidence DOUBLE, page_count INT, has_tables BOOLEAN, has_charts BOOLEAN, processed BOOLEAN,
    processing_error STRING, uploaded_at TIMESTAMP, processed_at TIMESTAMP, upload_day DATE
"""

# Partition columns, always last, and what they are made of. A delivery is one append: its rows become visible together.
PARTITIONS = {
    "documents": "upload_day",
    "financial_metrics": "delivery",
    "document_chunks": "delivery",
    "chunk_embeddings": "delivery",
    "investment_analysis": "delivery",
    "analysis_dimensions": "delivery",
    "generator_replies": "delivery",
    "document_counts": "upload_day",
    "metric_sums": "delivery",
    "period_metrics": "share",
    "cursors": "delivery",
}
# Columns by which rows are placed in buckets: texts and vectors are met there by ids and questions, and stay.
BUCKETS = {"document_chunks": ("chunk_id",), "chunk_embeddings": ("company_id", "slot")}
DERIVED = {"upload_day": "coalesce(to_date(uploaded_at), DATE '1970-01-01')"}
SHARES = 64

FINANCIAL_METRICS = """
    metric_id STRING NOT NULL, company_id STRING NOT NULL, document_id STRING NOT NULL, period_start STRING,
    period_end STRING, revenue DOUBLE, revenue_growth_rate DOUBLE, recurring_revenue DOUBLE, gross_margin DOUBLE,
    operating_margin DOUBLE, net_income DOUBLE, ebitda DOUBLE, cash_balance DOUBLE, burn_rate DOUBLE,
    runway_months DOUBLE, cac DOUBLE, ltv DOUBLE, ltv_cac_ratio DOUBLE, headcount INT, active_users INT,
    extracted_at TIMESTAMP, confidence_score DOUBLE, delivery STRING
"""

DOCUMENT_CHUNKS = """
    chunk_id STRING NOT NULL, company_id STRING NOT NULL, document_id STRING NOT NULL, text STRING NOT NULL,
    chunk_index INT, document_type STRING, page_number INT, section_title STRING, char_count INT,
    created_at TIMESTAMP, delivery STRING
"""

# A slot holds a bounded number of vectors of one company and delivery.
CHUNK_EMBEDDINGS = "chunk_id STRING NOT NULL, company_id STRING, slot BIGINT, embedding ARRAY<FLOAT>, delivery STRING"

INVESTMENT_ANALYSIS = """
    analysis_id STRING NOT NULL, company_id STRING NOT NULL, overall_score DOUBLE, recommendation STRING,
    confidence_level DOUBLE, executive_summary STRING, market_analysis STRING, competitive_moat STRING,
    team_assessment STRING, financial_analysis STRING, key_risks ARRAY<STRING>, key_opportunities ARRAY<STRING>,
    suggested_investment_amount DOUBLE, suggested_valuation DOUBLE, next_steps ARRAY<STRING>,
    analyzed_at TIMESTAMP, analyzed_by STRING, documents_analyzed INT, delivery STRING
"""

ANALYSIS_DIMENSIONS = """
    analysis_id STRING NOT NULL, company_id STRING NOT NULL, dimension STRING, weight DOUBLE, score DOUBLE,
    reasoning STRING, key_findings ARRAY<STRING>, delivery STRING
"""

# Documents of a company by day; a company's totals are their sums.
DOCUMENT_COUNTS = "company_id STRING NOT NULL, n_documents BIGINT, upload_day DATE"

# Sums of a delivery of metrics; a company's averages follow from those of all deliveries.
METRIC_SUMS = """
    company_id STRING NOT NULL, metric_count BIGINT, sum_revenue DOUBLE, sum_burn_rate DOUBLE, sum_runway DOUBLE,
    n_revenue BIGINT, n_burn_rate BIGINT, n_runway BIGINT, delivery STRING
"""

# Metrics of a company and period side by side, with what follows from them; companies are spread over shares.
PERIOD_METRICS = """
    company_id STRING NOT NULL, period STRING, period_key DATE, revenue DOUBLE, recurring_revenue DOUBLE,
    cash_balance DOUBLE, burn_rate DOUBLE, cac DOUBLE, ltv DOUBLE, revenue_growth_rate DOUBLE, ltv_cac_ratio DOUBLE,
    runway_months DOUBLE, share INT
"""

# Deliveries that a consumer has taken.
CURSORS = "consumer STRING NOT NULL, taken STRING NOT NULL, delivery STRING"

GENERATOR_REPLIES = "prompt_key STRING NOT NULL, model STRING NOT NULL, reply STRING, asked_at TIMESTAMP, delivery STRING"

TABLES = {
    "companies": COMPANIES,
    "documents": DOCUMENTS,
    "financial_metrics": FINANCIAL_METRICS,
    "document_chunks": DOCUMENT_CHUNKS,
    "chunk_embeddings": CHUNK_EMBEDDINGS,
    "investment_analysis": INVESTMENT_ANALYSIS,
    "analysis_dimensions": ANALYSIS_DIMENSIONS,
    "generator_replies": GENERATOR_REPLIES,
    "document_counts": DOCUMENT_COUNTS,
    "metric_sums": METRIC_SUMS,
    "period_metrics": PERIOD_METRICS,
    "cursors": CURSORS,
}

# One file as extracted: text, counts and its tables cell by cell.
CELL = "STRUCT<table_index: INT, table_name: STRING, row_index: INT, col_index: INT, row_label: STRING, " \
    "col_name: STRING, value: STRING>"
EXTRACTED_FIELDS = {
    "document_id": "STRING", "success": "BOOLEAN", "error": "STRING", "file_type": "STRING", "full_text": "STRING",
    "page_count": "INT", "page_starts": "ARRAY<INT>", "has_tables": "BOOLEAN", "has_charts": "BOOLEAN",
    "table_count": "INT", "paragraph_count": "INT", "sheet_count": "INT", "total_rows": "INT", "row_count": "INT",
    "col_count": "INT", "line_count": "INT", "char_count": "INT", "cells": f"ARRAY<{CELL}>",
}
EXTRACTED = ", ".join(f"{name} {kind}" for name, kind in EXTRACTED_FIELDS.items())
