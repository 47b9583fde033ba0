"""Registered queries: each operator over the given tables, with SQL for the check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import ids
from ledgerleaf.functions.constants import COMPANY_STAGES, METRIC_COLUMNS, RECOMMENDATIONS, TYPE_KEYWORDS
from ledgerleaf.functions.numbers import is_period, parse_amount, period_key
from ledgerleaf.functions.text import text_counts, url_filename
from ledgerleaf.operators import (
    answer,
    chunk as chunking,
    classify as classifying,
    metrics,
    pages,
    quality,
    report,
    retrieve,
    score,
    status,
)
from ledgerleaf.registry import inputs
from ledgerleaf.registry.views import AMOUNT, BLANKS, IS_PERIOD, LETTERS, METRIC_OF_LABEL, sql
from ledgerleaf.plans import analyse
from ledgerleaf.session import scratch_path, spread, stored_buckets
from ledgerleaf.sources import files, parsers
from ledgerleaf.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if check is not None:
            ORACLES[name] = check
        return function

    return register


def _r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# ------------------------------------------------------------------ classification


@query(
    "type_distribution",
    sql(
        "SELECT document_type, count(*) AS n_documents, round(avg(classification_confidence), 6) AS avg_confidence "
        "FROM classified GROUP BY document_type",
        "classified",
    ),
)
def type_distribution(spark, sf_dir):
    result = report.type_distribution(inputs.classified(spark, sf_dir))
    return result.withColumn("avg_confidence", _r("avg_confidence"))


@query(
    "folder_classification",
    sql("SELECT doc_id, type AS document_type, confidence FROM folder_signal", "folder_signal"),
)
def folder_classification(spark, sf_dir):
    return inputs.manifest(spark, sf_dir).select(
        "doc_id", classifying.folder_signal("relative_path").alias("s")
    ).select("doc_id", F.col("s.type").alias("document_type"), "s.confidence")


@query(
    "filename_classification",
    sql("SELECT doc_id, type AS document_type, round(confidence, 6) AS confidence FROM filename_signal", "filename_signal"),
)
def filename_classification(spark, sf_dir):
    return inputs.manifest(spark, sf_dir).select(
        "doc_id", classifying.filename_signal("filename", "relative_path").alias("s")
    ).select("doc_id", F.col("s.type").alias("document_type"), _r("s.confidence").alias("confidence"))


@query(
    "content_classification",
    sql("SELECT doc_id, type AS document_type, round(confidence, 6) AS confidence FROM content_signal", "content_signal"),
)
def content_classification(spark, sf_dir):
    lowered = spread(inputs.manifest(spark, sf_dir).select("doc_id", F.lower("text").alias("lowered")))
    return lowered.select("doc_id", classifying.content_signal("lowered").alias("s")).select(
        "doc_id", F.col("s.type").alias("document_type"), _r("s.confidence").alias("confidence")
    )


@query(
    "weighted_vote",
    sql(
        "SELECT doc_id, document_type, round(classification_confidence, 6) AS confidence FROM voted_with_content",
        "voted_with_content",
    ),
)
def weighted_vote(spark, sf_dir):
    documents = spread(inputs.manifest(spark, sf_dir).select("doc_id", "filename", "relative_path", "text"))
    voted = classifying.classify(documents, content="text")
    return voted.select("doc_id", "document_type", _r("classification_confidence").alias("confidence"))


def _named_type(prompts: list[str]) -> list[str]:
    """Scripted generator: names the first type word in the prompt's file name line, refuses what it does not know."""
    replies = []
    for prompt in prompts:
        name = prompt.split("Filename: ", 1)[1].split("\n", 1)[0].lower()
        if "scan" in name:
            raise ValueError("cannot tell")
        replies.append("Pitch Deck" if "pitch" in name or "deck" in name else " LEGAL\n" if "terms" in name else "memo")
    return replies


@query(
    "model_classification",
    sql(
        """SELECT m.doc_id,
          CASE WHEN contains(lower(filename), 'scan') THEN c.type
               WHEN contains(lower(filename), 'pitch') OR contains(lower(filename), 'deck') THEN 'pitch_deck'
               WHEN contains(lower(filename), 'terms') THEN 'legal' ELSE 'other' END AS document_type,
          CASE WHEN contains(lower(filename), 'scan') THEN round(c.confidence, 6) ELSE CAST(0.8 AS DOUBLE) END AS confidence
        FROM manifest m JOIN content_signal c USING (doc_id)""",
        "manifest", "content_signal",
    ),
)
def model_classification(spark, sf_dir):
    documents = inputs.manifest(spark, sf_dir).select("doc_id", "filename", "text")
    judged = classifying.classify_by_model(documents, _named_type, preview_chars=None)
    return judged.select(
        "doc_id", F.col("model_ballot.type").alias("document_type"), _r("model_ballot.confidence").alias("confidence")
    )


# ------------------------------------------------------------------ sources and registration


@query(
    "url_filenames",
    r"""SELECT page_id, CASE WHEN length(part) > 0 THEN url_decode(part) ELSE 'document_20240101_000000.pdf' END AS filename
    FROM (SELECT page_id, regexp_replace(regexp_extract(regexp_extract(url,
      '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '([^/]*)$', 1), ';.*$', '') AS part FROM pages)""",
)
def url_filenames(spark, sf_dir):
    as_of = F.lit(inputs.START).cast("timestamp")
    return inputs.table(spark, sf_dir, "pages").select("page_id", url_filename("url", as_of=as_of).alias("filename"))


@query(
    "url_list",
    "SELECT url, count(*) AS n FROM pages WHERE length(trim(url)) > 0 GROUP BY url",
)
def url_list(spark, sf_dir):
    # The URLs as lines of text files, padded and with blank lines between them, then read as a list.
    base = scratch_path(spark, "urls")
    lines = F.array(F.concat(F.lit("  "), F.col("url"), F.lit(" ")), F.lit(""))
    inputs.table(spark, sf_dir, "pages").select(F.explode(lines).alias("value")).write.text(base)
    return files.read_urls(spark, base).groupBy("url").agg(F.count("*").alias("n"))


@query(
    "fetched_documents",
    r"""SELECT substr(sha256(substr(md5(host), 1, 16) || '|' || url || '|' || sha256(html)), 1, 32) AS document_id,
      substr(md5(host), 1, 16) AS company_id, url AS source_url,
      regexp_extract(filename, '[^/](\.[^./]+)$', 1) AS file_type,
      CAST(octet_length(encode(html)) AS BIGINT) AS file_size_bytes, false AS processed
    FROM (SELECT *, lower(CASE WHEN length(part) > 0 THEN url_decode(part) ELSE 'document_20240101_000000.pdf' END) AS filename
      FROM (SELECT url, html, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(regexp_extract(url,
        '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '([^/]*)$', 1), ';.*$', '') AS part FROM pages))""",
)
def fetched_documents(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    fetched = files.fetched_manifest(
        inputs.table(spark, sf_dir, "pages"), ids.company_id(host), content="html",
        uploaded_at=F.lit(inputs.START).cast("timestamp"),
    )
    return fetched.select("document_id", "company_id", "source_url", "file_type", "file_size_bytes", "processed")


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))


def _decoded(expression: str) -> str:
    for entity, char in _ENTITIES:
        expression = f"replace({expression}, '{entity}', '{char}')"
    return f"trim(regexp_replace({expression}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')"


_TAGLESS = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), "
    r"'(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
)


# Text of a web page, given as ``html``.
PAGE_TEXT = _decoded(_TAGLESS)


@query(
    "page_text",
    "SELECT page_id, "
    + _decoded(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)")
    + " AS title, "
    + PAGE_TEXT
    + " AS text FROM pages",
)
def page_text(spark, sf_dir):
    return files.page_text(spread(inputs.table(spark, sf_dir, "pages"))).select("page_id", "title", "text")


@query(
    "storage_paths",
    sql(
        r"""SELECT document_id, CASE WHEN document_id = min(document_id) OVER (PARTITION BY p) THEN p
            ELSE dir || '/' || regexp_replace(filename, '\.[^.]+$', '') || '_' || substr(document_id, 1, 8)
              || regexp_extract(filename, '\.[^.]+$') END AS storage_path
        FROM (SELECT *, dir || '/' || filename AS p FROM (
          SELECT document_id, regexp_replace(filename, '_\d+\.', '.') AS filename,
            '/store/' || company_id || CASE WHEN contains(relative_path, '/') THEN '/' || regexp_extract(relative_path, '^(.*)/', 1) ELSE '' END AS dir
          FROM manifest))""",
        "manifest",
    ),
)
def storage_paths(spark, sf_dir):
    # Without their number, file names collide within a folder.
    shared = inputs.manifest(spark, sf_dir).withColumn("filename", F.regexp_replace("filename", r"_\d+\.", "."))
    placed = status.storage_paths(shared.select("document_id", "company_id", "filename", "relative_path"), "/store")
    return placed.select("document_id", "storage_path")


@query(
    "new_documents",
    """SELECT md5(text) AS content_id, count(*) AS copies FROM documents
    WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id)) GROUP BY 1""",
)
def new_documents(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").withColumn("content_id", F.md5("text"))
    known = documents.join(inputs.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    fresh = status.new_rows(documents.select("content_id"), known, "content_id")
    copies = documents.groupBy("content_id").agg(F.count("*").alias("copies"))
    return fresh.join(copies, "content_id")


@query(
    "upsert_companies",
    sql(
        """SELECT company_id, name, industry, stage, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
          strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at
        FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY updated_at DESC, is_new DESC, name DESC) AS rn,
                min(created) OVER (PARTITION BY company_id) AS created_at FROM (
          SELECT company_id, name, industry, stage, created_at AS created, created_at AS updated_at, 0 AS is_new FROM companies
          UNION ALL
          SELECT company_id, name || ' Inc', industry, 'growth', created_at + INTERVAL '1' DAY, created_at + INTERVAL '1' DAY, 1
          FROM companies WHERE industry = 'SaaS'
          UNION ALL
          SELECT substr(md5(c_mktsegment), 1, 16), c_mktsegment, NULL, NULL, TIMESTAMP '2024-03-01 00:00:00', TIMESTAMP '2024-03-01 00:00:00', 1
          FROM customer)) WHERE rn = 1""",
        "companies",
    ),
)
def upsert_companies(spark, sf_dir):
    existing = inputs.companies(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    later = F.col("created_at") + F.expr("INTERVAL '1' DAY")
    renamed = existing.filter(F.col("industry") == "SaaS").withColumns(
        {"name": F.concat("name", F.lit(" Inc")), "stage": F.lit("growth"), "created_at": later, "updated_at": later}
    )
    march = F.lit("2024-03-01 00:00:00").cast("timestamp")
    segments = inputs.table(spark, sf_dir, "customer").select(
        ids.company_id("c_mktsegment").alias("company_id"), F.col("c_mktsegment").alias("name"),
        march.alias("created_at"), march.alias("updated_at"),
    )
    merged = status.upsert_companies(existing, renamed.unionByName(segments, allowMissingColumns=True))
    return merged.withColumns({"created_at": _stamp("created_at"), "updated_at": _stamp("updated_at")})


@query(
    "work_list",
    sql(
        "SELECT document_id, company_id, filename, document_type, file_type FROM classified WHERE NOT coalesce(processed, false)",
        "classified",
    ),
)
def work_list(spark, sf_dir):
    documents = inputs.classified(spark, sf_dir).withColumn("file_path", F.col("relative_path"))
    return status.work_list(documents).drop("file_path")


@query(
    "status_merge",
    sql(
        """SELECT document_id, processed OR coalesce(success, false) AS processed,
          CASE WHEN NOT success THEN 'unreadable' WHEN coalesce(success, false) THEN NULL ELSE processing_error END AS processing_error,
          CASE WHEN coalesce(success, false) THEN length(m.text) ELSE page_count END AS page_count
        FROM manifest m LEFT JOIN (SELECT doc_id, quality = 1 AS success FROM labels) l USING (doc_id)""",
        "manifest",
    ),
)
def status_merge(spark, sf_dir):
    documents = inputs.manifest(spark, sf_dir).withColumns(
        {
            "processed_at": F.lit(None).cast("timestamp"),
            "has_tables": F.lit(None).cast("boolean"),
            "has_charts": F.lit(None).cast("boolean"),
        }
    )
    results = inputs.table(spark, sf_dir, "labels").join(documents.select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").cast("string").alias("document_id"),
        (F.col("quality") == 1).alias("success"),
        F.lit("unreadable").alias("error"),
        F.length("text").alias("page_count"),
        F.lit(False).alias("has_tables"),
        F.lit(False).alias("has_charts"),
    )
    merged = status.status_merge(documents.drop("text"), results)
    return merged.select("document_id", "processed", "processing_error", "page_count")


# ------------------------------------------------------------------ extraction and chunks


@query(
    "chunks",
    sql(
        "SELECT document_id, chunk_index, chunk_id, char_count, md5(text) AS text_md5, document_type FROM chunk_texts",
        "chunk_texts",
    ),
)
def chunks(spark, sf_dir):
    return inputs.document_chunks(spark, sf_dir).select(
        "document_id", "chunk_index", "chunk_id", "char_count", F.md5("text").alias("text_md5"), "document_type"
    )


@query(
    "chunk_stats",
    sql(
        """SELECT company_id, document_type, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents,
          CAST(sum(char_count) AS BIGINT) AS n_chars, max(char_count) AS longest, max(chunk_index) AS last_index
        FROM chunk_texts GROUP BY company_id, document_type""",
        "chunk_texts",
    ),
)
def chunk_stats(spark, sf_dir):
    made = inputs.document_chunks(spark, sf_dir)
    per_document = made.groupBy("company_id", "document_type", "document_id").agg(
        F.count("*").alias("n"), F.sum("char_count").alias("c"), F.max("char_count").alias("m"),
        F.max("chunk_index").alias("i"),
    )
    return per_document.groupBy("company_id", "document_type").agg(
        F.sum("n").alias("n_chunks"), F.count("*").alias("n_documents"), F.sum("c").alias("n_chars"),
        F.max("m").cast("long").alias("longest"), F.max("i").alias("last_index"),
    )


@query(
    "document_metadata",
    r"""SELECT doc_id, length(text) AS char_count, len(string_split(text, chr(10))) AS line_count,
      len(list_filter(string_split_regex(text, '\n[ \t]*\n'), lambda x: length(trim(x, ' ' || chr(9) || chr(10))) > 0)) AS paragraph_count
    FROM documents""",
)
def document_metadata(spark, sf_dir):
    counts = text_counts("text")
    return inputs.table(spark, sf_dir, "documents").select("doc_id", *(c.alias(name) for name, c in counts.items()))


@query(
    "latest_chunks",
    sql(
        """SELECT c.company_id, co.name AS company_name, c.document_type, md5(c.text) AS text_md5, c.chunk_index,
          strftime(c.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
        FROM (SELECT * FROM chunk_texts ORDER BY created_at DESC, chunk_id LIMIT 10) c LEFT JOIN companies co USING (company_id)""",
        "chunk_texts", "companies",
    ),
)
def latest_chunks(spark, sf_dir):
    newest = report.latest_chunks(inputs.document_chunks(spark, sf_dir), inputs.companies(spark, sf_dir))
    return newest.select(
        "company_id", "company_name", "document_type", F.md5("text").alias("text_md5"), "chunk_index",
        _stamp("created_at").alias("created_at"),
    )


@query(
    "page_documents",
    sql(
        """SELECT p.document_id, md5(p.text) AS text_md5, p.page_count, p.has_charts,
          array_to_string((SELECT list(s.at ORDER BY s.page) FROM page_starts s WHERE s.document_id = p.document_id), ',') AS page_starts
        FROM full_pages p""",
        "full_pages", "page_starts",
    ),
)
def page_documents(spark, sf_dir):
    joined = pages.page_documents(inputs.page_texts(spark, sf_dir), pages_per_block=3)
    return joined.select(
        "document_id", F.md5("full_text").alias("text_md5"), "page_count", "has_charts",
        F.array_join("page_starts", ",").alias("page_starts"),
    )


@query(
    "page_counts",
    sql(
        "SELECT document_id, page_count, CAST(length(text) AS BIGINT) AS char_count, has_charts FROM full_pages",
        "full_pages",
    ),
)
def page_counts(spark, sf_dir):
    return pages.page_counts(inputs.page_texts(spark, sf_dir))


@query(
    "chunk_locations",
    sql(
        """SELECT b.document_id, b.chunk_index, CAST(b.s AS BIGINT) AS chunk_start, max(p.page) AS page_number,
          max_by(p.title, p.page) AS section_title
        FROM page_bounds b JOIN full_pages f USING (document_id) JOIN page_starts p ON p.document_id = b.document_id AND p.at <= b.s
        WHERE b.whole OR length(trim(substr(f.text, b.s + 1, b.e - b.s), ' ' || chr(10))) > 0
        GROUP BY b.document_id, b.chunk_index, b.s""",
        "page_bounds", "page_starts", "full_pages",
    ),
)
def chunk_locations(spark, sf_dir):
    documents = pages.page_documents(inputs.page_texts(spark, sf_dir)).withColumn(
        "headings", chunking.heading_offsets("full_text")
    )
    cut = chunking.chunk(documents.select("document_id", F.col("full_text").alias("text"), "page_starts", "headings"))
    placed = chunking.add_section_title(chunking.add_page_number(cut))
    return placed.select(
        "document_id", "chunk_index", F.col("chunk_start").cast("long").alias("chunk_start"), "page_number", "section_title"
    )


# ------------------------------------------------------------------ financial metrics


@query(
    "period_columns",
    sql(
        f"SELECT col_name, {IS_PERIOD} AS is_period, count(*) AS n FROM cells GROUP BY 1, 2",
        "cells",
    ),
)
def period_columns(spark, sf_dir):
    return inputs.cells(spark, sf_dir).groupBy("col_name", is_period("col_name").alias("is_period")).agg(
        F.count("*").alias("n")
    )


@query(
    "metric_rows",
    sql(f"SELECT row_label, {METRIC_OF_LABEL} AS metric_name, count(*) AS n FROM cells GROUP BY 1, 2", "cells"),
)
def metric_rows(spark, sf_dir):
    return inputs.cells(spark, sf_dir).groupBy(
        "row_label", metrics.metric_of_label("row_label").alias("metric_name")
    ).agg(F.count("*").alias("n"))


@query(
    "parsed_values",
    sql(f"SELECT document_id, row_index, col_name, value AS raw, round({AMOUNT}, 6) AS value FROM cells", "cells"),
)
def parsed_values(spark, sf_dir):
    return inputs.cells(spark, sf_dir).select(
        "document_id", "row_index", "col_name", F.col("value").alias("raw"), _r(parse_amount("value")).alias("value")
    )


_LONG = (
    "SELECT metric_id, company_id, document_id, period, metric_name, value, confidence_score FROM "
)


@query("table_metrics", sql(_LONG + "table_metrics", "table_metrics"))
def table_metrics(spark, sf_dir):
    return metrics.table_metrics(inputs.cells(spark, sf_dir))


@query("text_metrics", sql(_LONG + "text_metrics", "text_metrics"))
def text_metrics(spark, sf_dir):
    return metrics.text_metrics(spread(inputs.statement_text(spark, sf_dir)))


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.combine(
        metrics.table_metrics(inputs.cells(spark, sf_dir)),
        metrics.text_metrics(spread(inputs.statement_text(spark, sf_dir))),
    )


def _wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.to_wide(long_metrics(spark, sf_dir)).drop("extracted_at")


def _wide_in_millions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenues in millions: averages near 1e14 have no exact dollars to print."""
    return _wide_metrics(spark, sf_dir).withColumn("revenue", F.col("revenue") / 1e6)


@query(
    "metrics_wide",
    sql(
        "SELECT metric_id, company_id, document_id, period_start, period_end, confidence_score, "
        + ", ".join(
            f"CAST({name} AS INT) AS {name}" if name in ("headcount", "active_users") else name
            for name in METRIC_COLUMNS
        )
        + " FROM metrics_wide",
        "metrics_wide",
    ),
)
def metrics_wide(spark, sf_dir):
    return _wide_metrics(spark, sf_dir)


@query(
    "best_metrics",
    sql(
        """SELECT company_id, period, metric_name, max_by(value, confidence_score || '/' || metric_id) AS value,
          max(confidence_score) AS confidence_score FROM metrics_long GROUP BY company_id, period, metric_name""",
        "metrics_long",
    ),
)
def best_metrics(spark, sf_dir):
    return metrics.best_per_period(long_metrics(spark, sf_dir))


@query(
    "derived_metrics",
    sql(
        """SELECT company_id, period,
          round(CASE WHEN ltv <> 0 AND cac <> 0 THEN ltv / cac ELSE ltv_cac_ratio END, 6) AS ltv_cac_ratio,
          round(CASE WHEN cash_balance <> 0 AND burn_rate <> 0 THEN cash_balance / burn_rate ELSE runway_months END, 6) AS runway_months
        FROM period_profile""",
        "period_profile",
    ),
)
def derived_metrics(spark, sf_dir):
    derived = metrics.derived_metrics(metrics.period_profile(long_metrics(spark, sf_dir)))
    return derived.select("company_id", "period", _r("ltv_cac_ratio").alias("ltv_cac_ratio"), _r("runway_months").alias("runway_months"))


@query(
    "revenue_growth",
    sql(
        """SELECT company_id, period, strftime(period_key, '%Y-%m-%d') AS period_key, round(revenue, 6) AS revenue,
          round(CASE WHEN prev <> 0 THEN (revenue - prev) / prev END, 6) AS revenue_growth_rate
        FROM (SELECT *, lag(revenue) OVER (PARTITION BY company_id ORDER BY period_key, period) AS prev FROM (
          SELECT *, make_date(CAST(right(period, 4) AS BIGINT), (CAST(substr(period, 2, 1) AS BIGINT) - 1) * 3 + 1, 1) AS period_key
          FROM period_profile WHERE period IS NOT NULL AND revenue IS NOT NULL))""",
        "period_profile",
    ),
)
def revenue_growth(spark, sf_dir):
    grown = metrics.revenue_growth(metrics.period_profile(long_metrics(spark, sf_dir)))
    return grown.select(
        "company_id", "period", F.date_format("period_key", "yyyy-MM-dd").alias("period_key"),
        _r("revenue").alias("revenue"), _r("revenue_growth_rate").alias("revenue_growth_rate"),
    )


@query(
    "period_keys",
    """SELECT label, strftime(key, '%Y-%m-%d') AS period_key, count(*) AS n FROM (
      SELECT 'FY' || strftime(o_orderdate, '%y') AS label, make_date(year(o_orderdate), 1, 1) AS key FROM orders
      UNION ALL SELECT strftime(o_orderdate, '%b %Y'), date_trunc('month', o_orderdate) FROM orders
      UNION ALL SELECT CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR), date_trunc('quarter', o_orderdate) FROM orders
      UNION ALL SELECT CAST(year(o_orderdate) AS VARCHAR), make_date(year(o_orderdate), 1, 1) FROM orders
      UNION ALL SELECT CASE o_orderkey % 2 WHEN 0 THEN 'TTM' ELSE 'YTD' END, NULL FROM orders) GROUP BY 1, 2""",
)
def period_keys(spark, sf_dir):
    when = F.col("o_orderdate")
    labels = F.array(
        F.concat(F.lit("FY"), F.date_format(when, "yy")),
        F.date_format(when, "MMM yyyy"),
        F.concat(F.year(when).cast("string"), F.lit("-Q"), F.quarter(when).cast("string")),
        F.year(when).cast("string"),
        F.when(F.col("o_orderkey") % 2 == 0, "TTM").otherwise("YTD"),
    )
    return (
        inputs.table(spark, sf_dir, "orders")
        .select(F.explode(labels).alias("label"))
        .filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count("*").alias("n"))
        .select("label", F.date_format(period_key("label"), "yyyy-MM-dd").alias("period_key"), "n")
    )


@query(
    "financial_summary",
    sql(
        """SELECT company_id, count(*) AS metric_count, round(avg(revenue), -2) AS avg_revenue, round(avg(burn_rate), 3) AS avg_burn_rate,
          round(avg(runway_months), 6) AS avg_runway FROM metrics_wide GROUP BY company_id""",
        "metrics_wide",
    ),
)
def financial_summary(spark, sf_dir):
    summary = report.financial_summary(_wide_metrics(spark, sf_dir))
    return summary.withColumns(
        {"avg_revenue": _r("avg_revenue", -2), "avg_burn_rate": _r("avg_burn_rate", 3), "avg_runway": _r("avg_runway")}
    )


@query(
    "company_metric_profile",
    sql(
        """SELECT company_id, round(revenue, -2) AS revenue, round(revenue_growth_rate, 6) AS revenue_growth_rate,
          round(gross_margin, 6) AS gross_margin, round(burn_rate, 3) AS burn_rate, round(runway_months, 6) AS runway_months,
          round(cac, 6) AS cac, round(ltv, 6) AS ltv, round(ltv_cac_ratio, 6) AS ltv_cac_ratio, CAST(headcount AS INT) AS headcount
        FROM profile""",
        "profile",
    ),
)
def company_metric_profile(spark, sf_dir):
    profile = score.metric_profile(_wide_metrics(spark, sf_dir))
    # Revenues reach 1e14, where an average is exact to some cents only.
    digits = {"revenue": -2, "burn_rate": 3}
    return profile.withColumns(
        {n: _r(n, digits.get(n, 6)) for n in profile.columns if n not in ("company_id", "headcount")}
    )


@query("financial_narrative", sql("SELECT company_id, financial_analysis FROM narrative", "narrative"))
def financial_narrative(spark, sf_dir):
    return score.metric_profile(_wide_in_millions(spark, sf_dir)).select(
        "company_id", score.financial_narrative().alias("financial_analysis")
    )


def _json_metrics(prompts: list[str]) -> list[str]:
    """Scripted generator: reads back the CAC and LTV of the text; replies in words where there is no 'K'."""
    replies = []
    for prompt in prompts:
        text = prompt.rsplit("Text:\n", 1)[1]
        cac = text.split("CAC: $", 1)[1].split(".", 1)[0]
        ltv = text.split("LTV ", 1)[1].split(".", 1)[0]
        replies.append('{"cac": %s, "ltv": %s, "revenue": null}' % (cac, ltv) if " months" in text else "none found")
    return replies


@query(
    "model_metrics",
    """SELECT document_id || '_llm_' || metric_name AS metric_id, document_id, metric_name, value, CAST(0.7 AS DOUBLE) AS confidence_score FROM (
      SELECT 'ord_' || CAST(o_orderkey AS VARCHAR) AS document_id, v.metric_name,
        CAST(CASE v.metric_name WHEN 'cac' THEN 50 + o_orderkey % 50 ELSE o_orderkey % 7 * 100 END AS DOUBLE) AS value
      FROM orders CROSS JOIN (VALUES ('cac'), ('ltv')) AS v(metric_name) WHERE o_orderkey % 2 = 0)""",
)
def model_metrics(spark, sf_dir):
    found = metrics.model_metrics(inputs.statement_text(spark, sf_dir), _json_metrics, max_chars=None)
    return found.select("metric_id", "document_id", "metric_name", "value", "confidence_score")


# ------------------------------------------------------------------ retrieval and answers

_CENTROIDS = """SELECT CAST(label AS VARCHAR) AS query_id, label, list(x ORDER BY pos) AS v FROM (
  SELECT label, pos, avg(x) AS x FROM (
    SELECT label, unnest(range(1, 65)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos) GROUP BY label"""


def _similarity(join: str, k: int) -> str:
    return f"""WITH q AS ({_CENTROIDS}) SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 6) AS score FROM (
      SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 9) AS score
        FROM embeddings e JOIN q ON {join})) WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("company_id"), "embedding"
    )


@query("similarity_topk", _similarity("true", 5))
def similarity_topk(spark, sf_dir):
    centroids = inputs.label_centroids(spark, sf_dir).withColumn("company_id", F.lit(None).cast("string"))
    return retrieve.search(centroids, _vectors(spark, sf_dir), k=5).withColumn("score", _r("score"))


@query("similarity_topk_filtered", _similarity("e.label = q.label", 3))
def similarity_topk_filtered(spark, sf_dir):
    centroids = inputs.label_centroids(spark, sf_dir).withColumn("company_id", F.col("label").cast("string"))
    return retrieve.search(centroids, _vectors(spark, sf_dir), k=3).withColumn("score", _r("score"))


@query(
    "similarity_many_questions",
    """SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(e.vec_id AS VARCHAR) AS chunk_id,
          round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score
        FROM embeddings q JOIN embeddings e ON e.label = q.label)) WHERE rank <= 2""",
)
def similarity_many_questions(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    questions = vectors.withColumnRenamed("chunk_id", "query_id")
    vectors = stored_buckets(retrieve.with_slots(vectors, vectors), "vectors", ["company_id", "slot"])
    return retrieve.search(questions, vectors, k=2, max_shared_vectors=64).withColumn("score", _r("score"))


def _chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as a written table, as retrieval finds them: made once, read for scoring and, by id, for the texts."""
    return stored_buckets(inputs.document_chunks(spark, sf_dir), "chunks", ["chunk_id"])


# Every company gets two questions; the regions have no documents at all. One question is for all companies.
_QUESTIONS = ("What are the main risks?", "Who are the target customers?")
_OPEN_QUESTION = "What is the revenue and growth rate?"


def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = inputs.companies(spark, sf_dir).select("company_id")
    unknown = inputs.table(spark, sf_dir, "region").select(ids.company_id("r_name").alias("company_id"))
    asked = answer.questions_for(known.unionByName(unknown), _QUESTIONS)
    # One open question, asked once however many regions there are.
    open_question = inputs.table(spark, sf_dir, "region").agg(F.min("r_name")).select(
        F.lit("open").alias("question_id"), F.lit(None).cast("string").alias("company_id"),
        F.lit(_OPEN_QUESTION).alias("question"),
    )
    return asked.unionByName(open_question)


ANSWERED_VIEWS = {
    "asked": f"""SELECT company_id || '_' || CAST(n AS VARCHAR) AS question_id, company_id, question FROM (
        SELECT company_id FROM companies UNION ALL SELECT substr(md5(r_name), 1, 16) FROM region)
      CROSS JOIN (VALUES (0, '{_QUESTIONS[0]}'), (1, '{_QUESTIONS[1]}')) AS v(n, question)
      UNION ALL SELECT 'open', NULL, '{_OPEN_QUESTION}'""",
    "vectors": f"SELECT chunk_id, company_id, document_id, document_type, text, {LETTERS} AS v FROM chunk_texts",
    "question_vectors": f"SELECT question_id, company_id, v FROM (SELECT question_id, company_id, {LETTERS.replace('text', 'question')} AS v FROM asked)",
    "found": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.question_id, c.chunk_id, c.document_id, c.document_type, c.text,
        CASE WHEN list_sum(c.v) = 0 THEN 0 ELSE round(list_cosine_similarity(q.v, c.v), 9) END AS score
      FROM question_vectors q JOIN vectors c ON q.company_id IS NULL OR q.company_id = c.company_id)) WHERE rank <= 3""",
}


@query(
    "retrieved_chunks",
    sql(
        "SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, document_type, md5(text) AS text_md5, round(score, 6) AS score FROM found",
        "chunk_texts", "companies", extra=ANSWERED_VIEWS,
    ),
)
def retrieved_chunks(spark, sf_dir):
    found = retrieve.retrieve(
        asked_questions(spark, sf_dir), _chunk_table(spark, sf_dir), inputs.letter_embedding, k=3
    )
    return found.select(
        "question_id", "rank", "chunk_id", "document_type", F.md5("text").alias("text_md5"), _r("score").alias("score")
    )


@query(
    "answer_context",
    sql(
        """SELECT question_id, count(*) AS num_sources,
          md5(string_agg('[Document ' || CAST(rank AS VARCHAR) || ' - ' || document_type || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5
        FROM found GROUP BY question_id""",
        "chunk_texts", "companies", extra=ANSWERED_VIEWS,
    ),
)
def answer_context(spark, sf_dir):
    found = retrieve.retrieve(
        asked_questions(spark, sf_dir), _chunk_table(spark, sf_dir), inputs.letter_embedding, k=3
    )
    return answer.context(found).select(
        "question_id", F.col("num_sources").cast("long").alias("num_sources"), F.md5("context").alias("context_md5")
    )


_ANSWERED = """SELECT a.question_id, a.company_id, coalesce(n, 0) AS num_sources,
      CASE WHEN n IS NULL THEN 'I don''t have enough information to answer that question based on the available documents.'
           ELSE trim(split_part(text, chr(10), 1), {blanks}) END AS answer,
      CASE WHEN n IS NULL THEN 0e0 END AS confidence
    FROM {asked} a LEFT JOIN (SELECT question_id, count(*) AS n, max(CASE WHEN rank = 1 THEN text END) AS text FROM found GROUP BY 1) f USING (question_id)"""


def _answered(asked: str) -> str:
    return sql(_ANSWERED.format(asked=asked, blanks=BLANKS), "chunk_texts", "companies", extra=ANSWERED_VIEWS)


@query("ask_batch", _answered("asked"))
def ask_batch(spark, sf_dir):
    answered = answer.ask(
        asked_questions(spark, sf_dir), _chunk_table(spark, sf_dir), embed=inputs.letter_embedding, k=3
    )
    return answered.select(
        "question_id", "company_id", F.col("num_sources").cast("long").alias("num_sources"), "answer", "confidence"
    )


@query("compare_companies", _answered(f"(SELECT * FROM asked WHERE question = '{_QUESTIONS[0]}')"))
def compare_companies(spark, sf_dir):
    known = inputs.companies(spark, sf_dir).select("company_id")
    unknown = inputs.table(spark, sf_dir, "region").select(ids.company_id("r_name").alias("company_id"))
    compared = answer.compare_companies(
        _QUESTIONS[0], known.unionByName(unknown), _chunk_table(spark, sf_dir), embed=inputs.letter_embedding, k=3
    )
    return compared.select(
        "question_id", "company_id", F.col("num_sources").cast("long").alias("num_sources"), "answer", "confidence"
    )


@query(
    "source_preview",
    sql(
        """SELECT question_id, CAST(rank AS INT) AS position, document_type, substr(text, 1, 100) AS preview FROM found""",
        "chunk_texts", "companies", extra=ANSWERED_VIEWS,
    ),
)
def source_preview(spark, sf_dir):
    answered = answer.ask(
        asked_questions(spark, sf_dir), _chunk_table(spark, sf_dir), embed=inputs.letter_embedding, k=3
    )
    return answer.source_preview(answered)


# ------------------------------------------------------------------ scoring


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.parse_dimensions(inputs.model_replies(spark, sf_dir))


@query(
    "dimension_parse",
    sql(
        """SELECT company_id, dimension, weight, ord, score, reasoning, array_to_string(key_findings, '|') AS key_findings
        FROM dimensions_parsed""",
        "dimensions_parsed",
    ),
)
def dimension_parse(spark, sf_dir):
    return _dimensions(spark, sf_dir).withColumn("key_findings", F.array_join("key_findings", "|"))


@query(
    "overall_score",
    sql(
        """SELECT company_id, round(overall_score, 6) AS overall_score, recommendation, round(confidence_level, 6) AS confidence_level
        FROM scored""",
        "scored",
    ),
)
def overall_score(spark, sf_dir):
    return score.scorecard(_dimensions(spark, sf_dir)).select(
        "company_id", _r("overall_score").alias("overall_score"), "recommendation",
        _r("confidence_level").alias("confidence_level"),
    )


@query(
    "memo_sections",
    sql("SELECT company_id, market_analysis, competitive_moat, team_assessment, key_risks FROM scores", "scores"),
)
def memo_sections(spark, sf_dir):
    return score.scorecard(_dimensions(spark, sf_dir)).select(
        "company_id", "market_analysis", "competitive_moat", "team_assessment",
        F.array_join("key_risks", "|").alias("key_risks"),
    )


@query(
    "key_opportunities",
    sql(
        "SELECT company_id, coalesce(key_opportunities, '') AS key_opportunities FROM scores LEFT JOIN opportunities USING (company_id)",
        "scores", "opportunities",
    ),
)
def key_opportunities(spark, sf_dir):
    return score.scorecard(_dimensions(spark, sf_dir)).select(
        "company_id", F.array_join("key_opportunities", "|").alias("key_opportunities")
    )


@query("next_steps", sql("SELECT company_id, next_steps FROM next_steps_of", "next_steps_of"))
def next_steps(spark, sf_dir):
    return score.scorecard(_dimensions(spark, sf_dir)).select(
        "company_id", F.array_join("next_steps", "|").alias("next_steps")
    )


@query(
    "top_dimensions",
    sql(
        """SELECT company_id, position, dimension, score FROM (
          SELECT company_id, dimension, score, CAST(row_number() OVER (PARTITION BY company_id ORDER BY score DESC, ord) AS INT) AS position
          FROM dimensions_parsed) WHERE position <= 3""",
        "dimensions_parsed",
    ),
)
def top_dimensions(spark, sf_dir):
    listed = score.scorecard(_dimensions(spark, sf_dir)).select(
        "company_id", F.posexplode("top_dimensions").alias("position", "top")
    )
    return listed.select("company_id", (F.col("position") + 1).alias("position"), "top.dimension", "top.score")


@query(
    "dimension_questions",
    sql(
        """SELECT company_id || '_' || dimension || '_' || CAST(question_number AS VARCHAR) AS question_id, company_id, dimension,
          ord, weight, question_number, question FROM companies CROSS JOIN dimension_questions""",
        "companies", "dimension_questions",
    ),
)
def dimension_questions(spark, sf_dir):
    return score.dimension_questions(inputs.companies(spark, sf_dir))


@query(
    "memo_dimensions",
    sql(
        """SELECT company_id, array_to_string(list_transform(string_split(dimension, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ': ' || format('{:.1f}', score) || '/10' AS heading,
          reasoning, CAST(i AS INT) AS position, finding FROM (
          SELECT d.*, unnest(CASE WHEN len(key_findings) = 0 THEN [NULL] ELSE key_findings END) AS finding,
            unnest(CASE WHEN len(key_findings) = 0 THEN [NULL] ELSE range(len(key_findings)) END) AS i FROM dimensions_parsed d)""",
        "dimensions_parsed",
    ),
)
def memo_dimensions(spark, sf_dir):
    return score.dimension_view(_dimensions(spark, sf_dir)).select("company_id", "heading", "reasoning", "position", "finding")


@query(
    "memo_view",
    sql(
        """SELECT company_id, format('{:.1f}', overall_score) || '/10' AS score_label, upper(recommendation) AS recommendation_label,
          format('{:.0f}', confidence_level * 100) || '%' AS confidence_label,
          array_to_string(list_transform(string_split(next_steps, '|'), lambda x, i: CAST(i AS VARCHAR) || '. ' || x), '|') AS numbered_steps
        FROM scored JOIN next_steps_of USING (company_id)""",
        "scored", "next_steps_of",
    ),
)
def memo_view(spark, sf_dir):
    return score.memo_view(score.scorecard(_dimensions(spark, sf_dir))).select(
        "company_id", "score_label", "recommendation_label", "confidence_label",
        F.array_join("numbered_steps", "|").alias("numbered_steps"),
    )


# ------------------------------------------------------------------ reports


@query(
    "processing_stats",
    sql(
        """SELECT document_type, count(*) AS total_documents, CAST(sum(CAST(processed AS INT)) AS BIGINT) AS processed,
          count(processing_error) AS errors, round(avg(page_count), 6) AS avg_pages FROM classified GROUP BY document_type""",
        "classified",
    ),
)
def processing_stats(spark, sf_dir):
    return report.processing_stats(inputs.classified(spark, sf_dir)).withColumn("avg_pages", _r("avg_pages"))


@query(
    "ingestion_summary",
    sql(
        """SELECT company_id, CAST(sum(n) AS BIGINT) AS documents_found, string_agg(document_type || '=' || CAST(n AS VARCHAR), ', ' ORDER BY document_type) AS document_types
        FROM (SELECT company_id, document_type, count(*) AS n FROM classified GROUP BY 1, 2) GROUP BY company_id""",
        "classified",
    ),
)
def ingestion_summary(spark, sf_dir):
    summary = report.ingestion_summary(inputs.classified(spark, sf_dir))
    entries = F.array_sort(F.map_entries("document_types"))
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return summary.withColumn("document_types", F.array_join(pairs, ", "))


@query(
    "documents_by_type",
    sql(
        """SELECT company_id, document_id, filename, document_type, status, size_mb,
          CASE document_type WHEN 'pitch_deck' THEN 'Pitch Deck' ELSE upper(document_type[1]) || document_type[2:] END
            || ' (' || CAST(count(*) OVER (PARTITION BY company_id, document_type) AS VARCHAR) || ')' AS heading,
          count(*) OVER (PARTITION BY company_id, document_type) AS n_documents
        FROM (SELECT *, CASE WHEN processed THEN 'Processed' ELSE 'Pending' END AS status,
          CAST(format('{:.1f}', file_size_bytes / 1048576) AS DOUBLE) AS size_mb FROM classified)""",
        "classified",
    ),
)
def documents_by_type(spark, sf_dir):
    return report.documents_by_type(inputs.classified(spark, sf_dir))


@query(
    "document_list",
    sql(
        """SELECT company_id, document_id, filename, document_type, CASE WHEN processed THEN 'Processed' ELSE 'Pending' END AS status,
          CAST(format('{:.1f}', file_size_bytes * 1000 / 1048576) AS DOUBLE) AS size_mb FROM classified""",
        "classified",
    ),
)
def document_list(spark, sf_dir):
    larger = inputs.classified(spark, sf_dir).withColumn("file_size_bytes", F.col("file_size_bytes") * 1000)
    return report.document_list(larger)


@query(
    "documents_with_company",
    sql(
        """SELECT d.company_id, c.name AS company_name, filename, document_type, round(classification_confidence, 6) AS classification_confidence,
          file_size_bytes, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at
        FROM classified d LEFT JOIN companies c USING (company_id)""",
        "classified", "companies",
    ),
)
def documents_with_company(spark, sf_dir):
    joined = report.documents_with_company(inputs.classified(spark, sf_dir), inputs.companies(spark, sf_dir))
    return joined.withColumns(
        {"classification_confidence": _r("classification_confidence"), "uploaded_at": _stamp("uploaded_at")}
    )


@query(
    "recent_companies",
    sql(
        """SELECT company_id, name, industry, stage, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM companies
        ORDER BY created_at DESC, company_id LIMIT 5""",
        "companies",
    ),
)
def recent_companies(spark, sf_dir):
    newest = report.newest(inputs.companies(spark, sf_dir), "created_at", "company_id", 5)
    return newest.withColumn("created_at", _stamp("created_at"))


@query(
    "companies_page",
    sql(
        "SELECT company_id, name FROM companies ORDER BY created_at DESC, company_id LIMIT 10 OFFSET 10",
        "companies",
    ),
)
def companies_page(spark, sf_dir):
    return report.newest(inputs.companies(spark, sf_dir), "created_at", "company_id", 10, 10).select("company_id", "name")


@query(
    "company_list",
    sql("SELECT company_id, name, industry, name || ' (' || industry || ')' AS display_name FROM companies", "companies"),
)
def company_list(spark, sf_dir):
    return report.company_list(inputs.companies(spark, sf_dir))


@query(
    "recent_analyses",
    sql(
        """SELECT c.name AS company_name, upper(recommendation) AS recommendation, strftime(analyzed_at, '%Y-%m-%d %H:%M:%S') AS analyzed_at
        FROM (SELECT * FROM analyses ORDER BY analyzed_at DESC, analysis_id LIMIT 5) a LEFT JOIN companies c USING (company_id)""",
        "analyses", "companies",
    ),
)
def recent_analyses(spark, sf_dir):
    recent = report.recent_analyses(inputs.analyses(spark, sf_dir), inputs.companies(spark, sf_dir))
    return recent.withColumn("analyzed_at", _stamp("analyzed_at"))


@query(
    "latest_analysis",
    sql(
        """SELECT analysis_id, company_id, recommendation, overall_score, strftime(analyzed_at, '%Y-%m-%d %H:%M:%S') AS analyzed_at FROM (
          SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY analyzed_at DESC, analysis_id DESC) AS rn FROM analyses) WHERE rn = 1""",
        "analyses",
    ),
)
def latest_analysis(spark, sf_dir):
    return report.latest_per_company(inputs.analyses(spark, sf_dir)).withColumn("analyzed_at", _stamp("analyzed_at"))


@query(
    "documents_per_company",
    sql("SELECT company_id, count(*) AS total_documents FROM manifest GROUP BY company_id", "manifest"),
)
def documents_per_company(spark, sf_dir):
    return report.documents_per_company(inputs.manifest(spark, sf_dir))


@query(
    "company_rollup",
    sql(
        """SELECT c.company_id, c.name, coalesce(n, 0) AS total_documents, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_analyzed
        FROM companies c LEFT JOIN (SELECT company_id, count(*) AS n FROM manifest GROUP BY 1) d USING (company_id)
        LEFT JOIN (SELECT company_id, max(analyzed_at) AS last FROM analyses GROUP BY 1) a USING (company_id)""",
        "companies", "manifest", "analyses",
    ),
)
def company_rollup(spark, sf_dir):
    rolled = report.company_rollup(
        inputs.companies(spark, sf_dir), inputs.manifest(spark, sf_dir), inputs.analyses(spark, sf_dir)
    )
    return rolled.select("company_id", "name", "total_documents", _stamp("last_analyzed").alias("last_analyzed"))


@query(
    "system_stats",
    sql(
        """SELECT CAST((SELECT count(*) FROM companies) AS DOUBLE) AS total_companies, CAST((SELECT count(*) FROM manifest) AS DOUBLE) AS total_documents,
          round((SELECT avg(CAST(processed AS INT)) * 100 FROM manifest), 6) AS processed_pct,
          CAST((SELECT count(*) FROM analyses) AS DOUBLE) AS total_analyses""",
        "companies", "manifest", "analyses",
    ),
)
def system_stats(spark, sf_dir):
    stats = report.system_stats(
        inputs.companies(spark, sf_dir), inputs.manifest(spark, sf_dir), inputs.analyses(spark, sf_dir)
    )
    return stats.withColumn("processed_pct", _r("processed_pct"))


@query(
    "run_summary",
    sql(
        """SELECT CAST((SELECT count(*) FROM manifest) AS DOUBLE) AS documents,
          CAST((SELECT count(*) FROM manifest WHERE processed) AS DOUBLE) AS processed,
          CAST((SELECT count(*) FROM chunk_texts) AS DOUBLE) AS chunks, CAST((SELECT count(*) FROM metrics_long) AS DOUBLE) AS metrics""",
        "manifest", "chunk_texts", "metrics_long",
    ),
)
def run_summary(spark, sf_dir):
    return report.run_summary(
        inputs.manifest(spark, sf_dir), inputs.document_chunks(spark, sf_dir), long_metrics(spark, sf_dir)
    )


@query(
    "table_counts",
    sql(
        """SELECT 'companies' AS table_name, count(*) AS n_rows FROM companies UNION ALL SELECT 'documents', count(*) FROM manifest
        UNION ALL SELECT 'investment_analysis', count(*) FROM analyses""",
        "companies", "manifest", "analyses",
    ),
)
def table_counts(spark, sf_dir):
    return report.table_counts(
        {
            "companies": inputs.companies(spark, sf_dir),
            "documents": inputs.manifest(spark, sf_dir),
            "investment_analysis": inputs.analyses(spark, sf_dir),
        }
    )


# ------------------------------------------------------------------ data quality


@query(
    "quality_report",
    sql(
        """SELECT * FROM (
          SELECT 'range' AS "check", 'overall_score' AS column_name, count(*) FILTER (overall_score NOT BETWEEN 0 AND 9) AS n_violations FROM analyses
          UNION ALL SELECT 'domain', 'recommendation', count(*) FILTER (recommendation NOT IN ('strong_buy', 'buy', 'hold', 'pass')) FROM analyses
          UNION ALL SELECT 'required', 'company_id', count(*) FILTER (company_id IS NULL) FROM analyses
          UNION ALL SELECT 'range', 'classification_confidence', count(*) FILTER (classification_confidence NOT BETWEEN 0 AND 1) FROM classified
          UNION ALL SELECT 'domain', 'document_type', count(*) FILTER (document_type NOT IN ('financial', 'pitch_deck', 'technical', 'legal', 'product', 'other')) FROM classified
          UNION ALL SELECT 'required', 'processing_error', count(*) FILTER (processing_error IS NULL) FROM classified
          UNION ALL SELECT 'domain', 'stage', count(*) FILTER (stage NOT IN ('pre_seed', 'seed', 'series_a', 'series_b', 'series_c_plus', 'growth')) FROM companies)""",
        "analyses", "classified", "companies",
    ),
)
def quality_report(spark, sf_dir):
    checks = quality.check_columns(
        inputs.analyses(spark, sf_dir), {"overall_score": (0, 9)}, {"recommendation": RECOMMENDATIONS}, ["company_id"]
    )
    documents = quality.check_columns(
        inputs.classified(spark, sf_dir), {"classification_confidence": (0, 1)},
        {"document_type": [*TYPE_KEYWORDS, "other"]}, ["processing_error"],
    )
    stages = quality.check_columns(inputs.companies(spark, sf_dir), domains={"stage": COMPANY_STAGES})
    return checks.unionByName(documents).unionByName(stages)


@query(
    "duplicate_texts",
    "SELECT md5(text) AS content_id, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_texts(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select(F.md5("text").alias("content_id"))
    return quality.duplicate_keys(documents, "content_id")


@query(
    "range_violations",
    sql("SELECT analysis_id, overall_score FROM analyses WHERE overall_score NOT BETWEEN 0 AND 5", "analyses"),
)
def range_violations(spark, sf_dir):
    broken = quality.violations(inputs.analyses(spark, sf_dir), {"overall_score": (0, 5)})
    return broken.select("analysis_id", "overall_score")


# ------------------------------------------------------------------ whole runs


def _summary(prompts: list[str]) -> list[str]:
    """Scripted generator: repeats the first strength, refuses companies that are passed on."""
    replies = []
    for prompt in prompts:
        if "Recommendation: PASS" in prompt:
            raise ValueError("nothing to say")
        strength = prompt.split("Strengths:\n- ", 1)[1].split("\n", 1)[0]
        overview = prompt.split("Overview: ", 1)[1].split("\n", 1)[0]
        replies.append(f"  {overview} is strong in {strength}. ")
    return replies


@query(
    "analysis_memo",
    sql(
        """SELECT a.company_id, round(overall_score, 6) AS overall_score, recommendation, round(confidence_level, 6) AS confidence_level,
          market_analysis, competitive_moat, team_assessment, key_risks, coalesce(key_opportunities, '') AS key_opportunities, next_steps,
          CASE WHEN recommendation = 'pass' THEN 'Investment analysis for ' || a.company_id || '. Overall score: ' || format('{:.1f}', overall_score) || '/10. Recommendation: PASS.'
               ELSE a.name || ' is strong in ' || top || '.' END AS executive_summary,
          coalesce(financial_analysis, 'Financial data not available.') AS financial_analysis, coalesce(n, 0) AS documents_analyzed, 'system' AS analyzed_by
        FROM (SELECT substr(md5('s' || CAST(s.company_id AS VARCHAR)), 1, 16) AS company_id, u.s_name AS name, s.company_id AS k,
                s.* EXCLUDE (company_id) FROM scored s JOIN supplier u ON u.s_suppkey = s.company_id) a
        JOIN (SELECT company_id AS k, next_steps FROM next_steps_of) ns USING (k)
        LEFT JOIN (SELECT company_id AS k, key_opportunities FROM opportunities) o USING (k)
        JOIN (SELECT company_id AS k, first(dimension || ': ' || format('{:.1f}', score) || '/10' ORDER BY score DESC, ord) AS top FROM dimensions_parsed GROUP BY 1) t USING (k)
        LEFT JOIN narrative f ON f.company_id = a.company_id
        LEFT JOIN (SELECT substr(md5('s' || CAST(doc_id % 20 AS VARCHAR)), 1, 16) AS company_id, CAST(count(*) AS INT) AS n FROM documents GROUP BY 1) d ON d.company_id = a.company_id""",
        "scored", "next_steps_of", "opportunities", "narrative", "dimensions_parsed",
    ),
)
def analysis_memo(spark, sf_dir):
    def company(column: str) -> Column:
        return ids.company_id(F.concat(F.lit("s"), F.col(column).cast("string")))

    cards = score.scorecard(_dimensions(spark, sf_dir)).withColumn("company_id", company("company_id"))
    overviews = inputs.table(spark, sf_dir, "supplier").select(
        company("s_suppkey").alias("company_id"), F.col("s_name").alias("overview")
    )
    documents = inputs.table(spark, sf_dir, "documents").withColumn("owner", F.col("doc_id") % 20).select(
        company("owner").alias("company_id")
    )
    memo = analyse.assemble(
        analyse.executive_summaries(cards, overviews, _summary), _wide_in_millions(spark, sf_dir), documents
    )
    return memo.select(
        "company_id", _r("overall_score").alias("overall_score"), "recommendation",
        _r("confidence_level").alias("confidence_level"), "market_analysis", "competitive_moat", "team_assessment",
        *[F.array_join(name, "|").alias(name) for name in ("key_risks", "key_opportunities", "next_steps")],
        "executive_summary", "financial_analysis", "documents_analyzed", "analyzed_by",
    )


def _judge(prompts: list[str]) -> list[str]:
    """Scripted generator: a score that follows from the length of the prompt."""
    return [
        '```json\n{"score": %.1f, "reasoning": "%d", "key_findings": []}\n```' % (len(p) * 7 % 101 / 10, len(p))
        for p in prompts
    ]


@query(
    "dimension_analysis",
    sql(
        """SELECT company_id, dimension, weight, ord, round((n * 7 % 101) / 10, 6) AS score, CAST(n AS VARCHAR) AS reasoning FROM (
          SELECT company_id, dimension, weight, ord,
            length('Judge a company''s ' || replace(dimension, '_', ' ') || ' from these answers:' || chr(10) || chr(10)
              || string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) || chr(10) ORDER BY question_number))
            + length(chr(10) || chr(10) || 'Reply with one JSON object: "score" is a number from 0 (poor) over 5 (average) to 10 (excellent), '
              || '"reasoning" explains it in two or three sentences, "key_findings" lists two or three findings.') AS n
          FROM answers GROUP BY company_id, dimension, weight, ord)""",
        "chunk_texts", "companies", "dimension_questions",
        extra={
            "vectors": ANSWERED_VIEWS["vectors"],
            "question_vectors": f"SELECT * EXCLUDE (text), {LETTERS} AS v FROM (SELECT *, question AS text FROM dimension_questions)",
            "answers": """SELECT company_id, dimension, weight, ord, question_number, question, trim(split_part(text, chr(10), 1), BLANKS) AS answer FROM (
              SELECT c.company_id, q.dimension, q.weight, q.ord, q.question_number, q.question, c.text, row_number() OVER (PARTITION BY c.company_id, q.dimension, q.question_number
                ORDER BY CASE WHEN list_sum(c.v) = 0 THEN 0 ELSE round(list_cosine_similarity(q.v, c.v), 9) END DESC, c.chunk_id) AS rank
              FROM vectors c CROSS JOIN question_vectors q) WHERE rank = 1""".replace("BLANKS", BLANKS),
        },
    ),
)
def dimension_analysis(spark, sf_dir):
    chunks = _chunk_table(spark, sf_dir)
    judged = analyse.judge_dimensions(
        inputs.companies(spark, sf_dir), chunks, answer.extractive_reply, _judge, inputs.letter_embedding
    )
    return judged.select("company_id", "dimension", "weight", "ord", _r("score").alias("score"), "reasoning")


@query(
    "incremental_ingest",
    sql(
        """SELECT c.document_type, count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_chunks, CAST(sum(chars) AS BIGINT) AS n_chars
        FROM classified c JOIN (SELECT document_id, count(*) AS n, coalesce(sum(char_count), 0) AS chars FROM chunk_texts GROUP BY 1) USING (document_id)
        GROUP BY c.document_type""",
        "classified", "chunk_texts",
    ),
)
def incremental_ingest(spark, sf_dir):
    target, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "offsets")
    columns = ("document_id", "company_id", "filename", "relative_path", "text")
    incremental.incremental(
        spark, f"{sf_dir}/documents*.parquet", "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
        target, checkpoint, lambda rows: inputs.manifest_of(rows).select(*columns),
    ).awaitTermination()
    chunks = spark.read.parquet(f"{target}/chunks").groupBy("document_id").agg(
        F.count("*").alias("n"), F.sum("char_count").alias("chars")
    )
    return spark.read.parquet(f"{target}/documents").join(chunks, "document_id").groupBy("document_type").agg(
        F.count("*").alias("n_documents"), F.sum("n").alias("n_chunks"), F.sum("chars").alias("n_chars")
    )


@query(
    "text_files",
    """SELECT source AS company_folder, count(*) AS n_lines, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars
    FROM documents WHERE source IS NOT NULL GROUP BY source""",
)
def text_files(spark, sf_dir):
    # Documents as lines of text files, one folder per company, then read back as files.
    base = scratch_path(spark, "texts")
    lines = inputs.table(spark, sf_dir, "documents").select(
        F.col("source").alias("company"), F.translate("text", "\r\n", "  ").alias("value")
    )
    # A company with much text has more files, not larger ones.
    lines.write.option("maxRecordsPerFile", 5000).partitionBy("company").text(base)
    found = files.company_files(spark, base).filter(F.col("file_type") == ".txt")
    named = found.withColumns(
        {"document_id": F.col("path"), "folder": F.replace(F.col("company_folder"), F.lit("company="), F.lit(""))}
    )
    read = parsers.extract(named, keep=("folder",))
    return read.groupBy(F.col("folder").alias("company_folder")).agg(
        F.sum(F.col("line_count") - 1).alias("n_lines"), F.sum("char_count").alias("n_chars")
    )


@query(
    "csv_files",
    sql(
        "SELECT company_id, metric_name, count(*) AS n, round(sum(value), 2) AS total FROM table_metrics GROUP BY 1, 2",
        "table_metrics",
    ),
)
def csv_files(spark, sf_dir):
    # Statements as CSV files, a folder per company and a column per heading, then read back as tables.
    base = scratch_path(spark, "statements")
    given = inputs.cells(spark, sf_dir)
    # Headings of a file's columns: as many as the calendar has quarters.
    periods = [r.col_name for r in given.select("col_name").distinct().orderBy("col_name").collect()]
    wide = (
        given
        .groupBy("company_id", "document_id", "row_label")
        .agg(*[F.max(F.when(F.col("col_name") == p, F.col("value"))).alias(p) for p in periods])
        .select(F.col("company_id").alias("company"), F.col("row_label").alias("label"), *[F.col(f"`{p}`") for p in periods])
    )
    wide.write.partitionBy("company").option("header", True).csv(base)
    found = files.company_files(spark, base).filter(F.col("file_type") == ".csv")
    named = found.withColumns(
        {"document_id": F.col("path"), "company_id": F.replace(F.col("company_folder"), F.lit("company="), F.lit(""))}
    )
    cells = parsers.extracted_cells(parsers.extract(named, keep=("company_id",)))
    return metrics.table_metrics(cells).groupBy("company_id", "metric_name").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )
