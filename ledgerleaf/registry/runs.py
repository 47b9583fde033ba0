"""Registered queries over whole runs: they write managed tables and read their result from these."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import ids
from ledgerleaf.operators import answer, metrics, report
from ledgerleaf.plans import ingest, process
from ledgerleaf.registry import inputs
from ledgerleaf.registry.queries import ANSWERED_VIEWS, PAGE_TEXT, asked_questions, long_metrics, query
from ledgerleaf.registry.views import BLANKS, LETTERS, chunk_bounds, sql
from ledgerleaf.session import scratch_path, stored
from ledgerleaf.sinks import tables
from ledgerleaf.streaming import incremental


@contextmanager
def scratch_database(spark: SparkSession) -> Iterator[str]:
    """A database of managed tables that is dropped afterwards; results are stored before."""
    database = f"run_{uuid.uuid4().hex}"
    tables.create_tables(spark, database, buckets=spark.sparkContext.defaultParallelism)
    try:
        yield database
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def _letters(df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
    return inputs.letter_embedding(df, text, out)


_PAGE_CHUNK = f"CASE WHEN b.whole THEN f.text ELSE trim(substr(f.text, b.s + 1, b.e - b.s), {BLANKS}) END"


@query(
    "page_chunks_run",
    sql(
        f"""SELECT CAST(document_id AS VARCHAR) AS document_id, chunk_index, page_number, section_title, md5(text) AS text_md5,
          length(text) AS char_count, page_count, has_charts, true AS processed
        FROM (
          SELECT b.document_id, b.chunk_index, {_PAGE_CHUNK} AS text, b.whole, max(p.page) AS page_number,
            max_by(p.title, p.page) AS section_title, any_value(f.page_count) AS page_count, any_value(f.has_charts) AS has_charts
          FROM page_bounds b JOIN full_pages f USING (document_id) JOIN page_starts p ON p.document_id = b.document_id AND p.at <= b.s
          GROUP BY ALL)
        WHERE whole OR length(text) > 0""",
        "page_bounds", "page_starts", "full_pages",
    ),
)
def page_chunks_run(spark, sf_dir):
    # Conversations as documents of which another job decoded the pages, processed as a whole run does.
    pages = inputs.page_texts(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string"))
    name = F.concat(F.lit("talk_"), F.col("document_id"), F.lit(".pdf"))
    documents = pages.select("document_id").distinct().select(
        "document_id", ids.company_id("document_id").alias("company_id"), name.alias("filename"), name.alias("file_path"),
        F.lit(".pdf").alias("file_type"), F.lit("other").alias("document_type"), F.lit(False).alias("processed"),
        inputs.start_of("document_id").alias("uploaded_at"),
    )
    with scratch_database(spark) as database:
        tables.register_documents(documents, f"{database}.documents")
        process.process_documents(spark, database, pages=pages, embed=_letters)
        found = spark.table(f"{database}.document_chunks").join(
            spark.table(f"{database}.documents").select("document_id", "page_count", "has_charts", "processed"), "document_id"
        )
        return stored(
            found.select(
                "document_id", "chunk_index", "page_number", "section_title", F.md5("text").alias("text_md5"), "char_count",
                "page_count", "has_charts", "processed",
            ),
            "result",
        )


@query(
    "fetched_run",
    sql(
        f"""SELECT d.document_id, company_id, '.html' AS file_type, n_documents, true AS processed, chunk_index,
          md5({_PAGE_CHUNK.replace("f.", "d.")}) AS text_md5
        FROM web_texts d JOIN web_bounds b USING (document_id), (SELECT count(*) AS n_documents FROM web_texts)
        WHERE b.whole OR length({_PAGE_CHUNK.replace("f.", "d.")}) > 0""",
        extra={
            "web_texts": rf"""SELECT DISTINCT substr(sha256(substr(md5(host), 1, 16) || '|' || url || '|' || sha256(html)), 1, 32) AS document_id,
              substr(md5(host), 1, 16) AS company_id, {PAGE_TEXT} AS text
              FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)""",
            "web_bounds": chunk_bounds("web_texts"),
        },
    ),
)
def fetched_run(spark, sf_dir):
    # Web pages as payloads that were fetched, some of them twice, from registration to chunks.
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    fetched = inputs.table(spark, sf_dir, "pages").select("url", F.encode("html", "UTF-8").alias("content"), ids.company_id(host).alias("company"))
    fetched = fetched.unionByName(fetched.filter(F.length("content") % 3 == 0))
    given = {"uploaded_at": F.lit(inputs.START).cast("timestamp")}
    with scratch_database(spark) as database:
        ingest.ingest_fetched(fetched, "company", database, **given)
        payloads = ingest.classified_payloads(fetched, "company", with_content=True, **given)
        process.process_documents(spark, database, payloads, embed=_letters)
        documents = spark.table(f"{database}.documents")
        counted = documents.agg(F.count(F.lit(1)).alias("n_documents"))
        found = spark.table(f"{database}.document_chunks").drop("company_id").join(documents, "document_id")
        found = found.select("document_id", "company_id", "file_type", "processed", "chunk_index", F.md5("text").alias("text_md5"))
        return stored(found.withColumn("n_documents", F.lit(counted.first()[0])), "result")


@query(
    "index_sync",
    sql(
        """SELECT company_id, count(*) AS n_chunks, CAST(sum(list_sum(v)) AS BIGINT) AS n_letters, 2 AS deliveries, 2 AS synced
        FROM vectors GROUP BY company_id""",
        "chunk_texts", extra={"vectors": f"SELECT company_id, {LETTERS} AS v FROM chunk_texts"},
    ),
)
def index_sync(spark, sf_dir):
    # Labelled documents come first, then all, so that the second delivery has much that is known already.
    chunks = stored(inputs.document_chunks(spark, sf_dir), "chunks")
    labelled = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    synced = 0
    with scratch_database(spark) as database:
        for arrived in (chunks.join(labelled, "document_id", "left_semi"), chunks):
            tables.append_documents(stored(arrived, "arrived"), f"{database}.document_chunks")
            synced += process.sync_embeddings(spark, database, _letters)
        synced += process.sync_embeddings(spark, database, _letters)
        deliveries = len(tables.partitions(spark, f"{database}.chunk_embeddings"))
        total = F.aggregate("embedding", F.lit(0.0), lambda x, y: x + y)
        found = spark.table(f"{database}.chunk_embeddings").groupBy("company_id").agg(
            F.count(F.lit(1)).alias("n_chunks"), F.sum(total).cast("long").alias("n_letters"),
            F.lit(deliveries).alias("deliveries"), F.lit(synced).alias("synced"),
        )
        return stored(found, "result")


_PROMPTS = """SELECT count(DISTINCT prompt) AS n FROM (
  SELECT f.question_id, a.question || chr(10) || string_agg(f.document_type || chr(10) || f.text, chr(10) ORDER BY rank) AS prompt
  FROM found f JOIN asked a USING (question_id) GROUP BY f.question_id, a.question)"""


@query(
    "generator_rerun",
    sql(
        f"""SELECT a.question_id, CASE WHEN text IS NULL THEN 'I don''t have enough information to answer that question based on the available documents.'
          ELSE trim(split_part(text, chr(10), 1), {BLANKS}) END AS answer, p.n AS asked_first, CAST(0 AS BIGINT) AS asked_again
        FROM asked a LEFT JOIN (SELECT question_id, text FROM found WHERE rank = 1) f USING (question_id), ({_PROMPTS}) p""",
        "chunk_texts", "companies", extra=ANSWERED_VIEWS,
    ),
)
def generator_rerun(spark, sf_dir):
    # The same questions twice: the second run finds every reply of the first.
    questions = asked_questions(spark, sf_dir)
    chunks = stored(inputs.document_chunks(spark, sf_dir), "chunks")
    with scratch_database(spark) as database:
        table = f"{database}.generator_replies"
        kept = tables.StoredReplies(spark, table, "extractive")
        asked = []
        for _ in range(2):
            before = spark.table(table).count()
            answered = answer.ask(questions, chunks, embed=_letters, k=3, replies=kept)
            asked.append(spark.table(table).count() - before)
        result = answered.select("question_id", "answer", F.lit(asked[0]).cast("long").alias("asked_first"), F.lit(asked[1]).cast("long").alias("asked_again"))
        return stored(result, "result")


@query(
    "process_run",
    sql(
        """SELECT company_id, count(*) AS n_documents, count(*) AS n_processed, count(*) AS n_chunks, count(*) AS n_vectors,
          any_value(n_metrics) AS n_metrics, any_value(burn_rate) AS avg_burn_rate, any_value(runway) AS avg_runway,
          any_value(ratio) AS ltv_cac_ratio
        FROM statement_text JOIN (
          SELECT company_id, count(*) AS n_metrics, round(avg(CASE WHEN metric_name = 'burn_rate' THEN value END), 3) AS burn_rate,
            round(avg(CASE WHEN metric_name = 'runway_months' THEN value END), 6) AS runway,
            round(CASE WHEN max(CASE WHEN metric_name = 'ltv' THEN value END) <> 0 THEN
              max(CASE WHEN metric_name = 'ltv' THEN value END) / max(CASE WHEN metric_name = 'cac' THEN value END) END, 6) AS ratio
          FROM text_metrics GROUP BY company_id) USING (company_id)
        GROUP BY company_id""",
        "statement_text", "text_metrics",
    ),
)
def process_run(spark, sf_dir):
    # Updates as one-page documents, from registration to chunks, vectors, metrics, what follows from these, and status.
    texts = inputs.statement_text(spark, sf_dir)
    name = F.concat(F.col("document_id"), F.lit(".pdf"))
    documents = texts.select(
        "document_id", "company_id", name.alias("filename"), name.alias("file_path"), F.lit(".pdf").alias("file_type"),
        F.lit("financial").alias("document_type"), F.lit(False).alias("processed"), F.lit(inputs.START).cast("timestamp").alias("uploaded_at"),
    )
    pages = texts.select("document_id", F.lit(1).alias("page"), "text", F.lit(0).alias("n_images"))
    with scratch_database(spark) as database:
        tables.register_documents(documents, f"{database}.documents")
        process.process_documents(spark, database, pages=pages, embed=_letters)

        def counted(table: str, *measures: Column) -> DataFrame:
            return spark.table(f"{database}.{table}").groupBy("company_id").agg(*measures)

        every = F.count(F.lit(1))
        found = counted("documents", every.alias("n_documents"), F.count_if("processed").alias("n_processed"))
        found = found.join(counted("document_chunks", every.alias("n_chunks")), "company_id")
        found = found.join(counted("chunk_embeddings", every.alias("n_vectors")), "company_id")
        sums = report.summary_of_sums(spark.table(f"{database}.metric_sums"))
        found = found.join(sums, "company_id").join(counted("period_metrics", F.max("ltv_cac_ratio").alias("ratio")), "company_id")
        return stored(
            found.select(
                "company_id", "n_documents", "n_processed", "n_chunks", "n_vectors", F.col("metric_count").alias("n_metrics"),
                F.round("avg_burn_rate", 3).alias("avg_burn_rate"), F.round("avg_runway", 6).alias("avg_runway"),
                F.round("ratio", 6).alias("ltv_cac_ratio"),
            ),
            "result",
        )


_GROWTH = """SELECT company_id, period, revenue, CASE WHEN prev <> 0 THEN (revenue - prev) / prev END AS growth FROM (
  SELECT *, lag(revenue) OVER (PARTITION BY company_id ORDER BY key, period) AS prev FROM (
    SELECT *, make_date(CAST(right(period, 4) AS BIGINT), (CAST(substr(period, 2, 1) AS BIGINT) - 1) * 3 + 1, 1) AS key
    FROM period_profile WHERE period IS NOT NULL AND revenue IS NOT NULL{late}))"""


@query(
    "growth_after_late_period",
    sql(
        """SELECT a.company_id, a.period, round(a.revenue, 6) AS revenue, round(b.growth, 6) AS growth_before, round(a.growth, 6) AS growth_after
        FROM after_all a LEFT JOIN before_late b ON a.company_id = b.company_id AND a.period = b.period""",
        "period_profile",
        extra={"after_all": _GROWTH.format(late=""), "before_late": _GROWTH.format(late=" AND period NOT LIKE 'Q2%'")},
    ),
)
def growth_after_late_period(spark, sf_dir):
    # Second quarters are delivered late: each reopens the third quarter behind it.
    wide = stored(metrics.to_wide(long_metrics(spark, sf_dir)), "metrics")
    late = F.coalesce(F.col("period_start").startswith("Q2"), F.lit(False))
    with scratch_database(spark) as database:
        seen = []
        for arrived in (wide.filter(~late), wide.filter(late)):
            tables.append_new(arrived, f"{database}.financial_metrics")
            process.update_periods(spark, database)
            dated = spark.table(f"{database}.period_metrics").filter("period_key IS NOT NULL AND revenue IS NOT NULL")
            seen.append(stored(dated.select("company_id", "period", "revenue", "revenue_growth_rate"), "periods"))
        before = seen[0].select("company_id", "period", F.round("revenue_growth_rate", 6).alias("growth_before"))
        after = seen[1].select(
            "company_id", "period", F.round("revenue", 6).alias("revenue"), F.round("revenue_growth_rate", 6).alias("growth_after")
        )
        return after.join(before, ["company_id", "period"], "left")


@query(
    "rollup_after_two_runs",
    sql(
        """SELECT company_id, count(*) AS total_documents, any_value(n) AS metric_count, any_value(burn_rate) AS avg_burn_rate, any_value(runway) AS avg_runway
        FROM manifest LEFT JOIN (
          SELECT company_id, count(*) AS n, round(avg(burn_rate), 3) AS burn_rate, round(avg(runway_months), 6) AS runway FROM metrics_wide GROUP BY 1) USING (company_id)
        GROUP BY company_id""",
        "manifest", "metrics_wide",
    ),
)
def rollup_after_two_runs(spark, sf_dir):
    # Labelled documents first, then all; metrics of tables first, then those of prose. Each run adds its own to the totals.
    manifest = inputs.manifest(spark, sf_dir).drop("text", "processing_error", "page_count")
    documents = stored(manifest.withColumn("file_path", F.col("relative_path")), "manifest")
    labelled = inputs.table(spark, sf_dir, "labels").select("doc_id").distinct()
    wide = stored(metrics.to_wide(long_metrics(spark, sf_dir)), "metrics")
    dated = F.col("period_start").isNotNull()
    runs = (
        (documents.join(labelled, "doc_id", "left_semi"), wide.filter(dated)),
        (documents, wide.filter(~dated)),
    )
    with scratch_database(spark) as database:
        tables.register_companies(inputs.companies(spark, sf_dir), f"{database}.companies")
        for arrived, measured in runs:
            arrived = stored(arrived.drop("doc_id"), "arrived")
            tables.register_documents(arrived, f"{database}.documents")
            tables.update_rollup(spark, database, arrived)
            tables.append_new(measured, f"{database}.financial_metrics")
            process.update_periods(spark, database)
        sums = report.summary_of_sums(spark.table(f"{database}.metric_sums"))
        found = spark.table(f"{database}.companies").join(sums, "company_id", "left")
        return stored(
            found.select(
                "company_id", F.col("total_documents").cast("long").alias("total_documents"), "metric_count",
                F.round("avg_burn_rate", 3).alias("avg_burn_rate"), F.round("avg_runway", 6).alias("avg_runway"),
            ),
            "result",
        )


@query(
    "unreadable_files",
    """SELECT DISTINCT substr(md5(source), 1, 16) AS company_id, length(source) % 2 = 1 AS processed_first,
      CASE WHEN length(source) % 2 = 0 THEN 'File could not be read' END AS error_first, true AS processed_second,
      CAST(NULL AS VARCHAR) AS error_second
    FROM documents WHERE source IS NOT NULL""",
)
def unreadable_files(spark, sf_dir):
    # Text files of some companies are out of reach between listing and reading, and back in the next run.
    base, away = scratch_path(spark, "texts"), scratch_path(spark, "away")
    texts = inputs.table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    texts.select(F.col("source").alias("company"), F.translate("text", "\r\n", "  ").alias("value")).write.partitionBy("company").text(base)
    names = texts.select(F.col("source").alias("name")).distinct()
    companies = stored(names.withColumn("folder", F.concat(F.lit("company="), F.col("name"))), "companies")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [status.getPath().getName() for status in system.listStatus(path(base)) if status.isDirectory()]
    hidden = [name for name in folders if len(name.split("=", 1)[1]) % 2 == 0]
    system.mkdirs(path(away))
    with scratch_database(spark) as database:
        ingest.ingest_folders(spark, base, companies, database)
        seen = []
        for out_of_reach in (hidden, []):
            listed = stored(ingest.classified_folder(spark, base, companies).select("document_id"), "listed")
            files = ingest.classified_folder(spark, base, companies, with_content=True)
            for name in out_of_reach:
                system.rename(path(f"{base}/{name}"), path(f"{away}/{name}"))
            process.process_documents(spark, database, files, embed=_letters, listed=listed)
            for name in out_of_reach:
                system.rename(path(f"{away}/{name}"), path(f"{base}/{name}"))
            status = spark.table(f"{database}.documents").groupBy("company_id").agg(
                F.bool_and("processed").alias("processed"), F.max("processing_error").alias("error")
            )
            seen.append(stored(status, "status"))
    first, second = (s.select("company_id", F.col("processed").alias(f"processed_{n}"), F.col("error").alias(f"error_{n}")) for s, n in zip(seen, ("first", "second")))
    return first.join(second, "company_id")


@query(
    "redelivery",
    sql(
        """SELECT company_id, count(*) AS n_documents, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, any_value(n_metrics) AS n_metrics
        FROM statement_text JOIN (SELECT company_id, count(*) AS n_metrics FROM text_metrics GROUP BY 1) USING (company_id) GROUP BY company_id""",
        "statement_text", "text_metrics",
    ),
)
def redelivery(spark, sf_dir):
    # Updates that report months arrive first, then all updates, then all once more.
    name = F.concat(F.lit("Q1_2024_P&L_"), F.col("document_id"), F.lit(".txt"))
    documents = inputs.statement_text(spark, sf_dir).withColumns(
        {"filename": name, "relative_path": F.concat(F.lit("financials/"), name)}
    )
    source, target, checkpoint = (scratch_path(spark, kind) for kind in ("arrivals", "ingested", "offsets"))
    schema = "document_id STRING, company_id STRING, text STRING, filename STRING, relative_path STRING"
    for arrived in (documents.filter(F.col("text").contains(" months")), documents, documents):
        arrived.write.mode("append").parquet(source)
        incremental.incremental(spark, source, schema, target, checkpoint).awaitTermination()

    def stored_rows(kind: str, *measures: Column) -> DataFrame:
        return spark.read.parquet(f"{target}/{kind}").groupBy("company_id").agg(*measures)

    every = F.count(F.lit(1))
    found = stored_rows("documents", every.alias("n_documents")).join(
        stored_rows("chunks", every.alias("n_chunks"), F.sum("char_count").alias("n_chars")), "company_id"
    )
    return found.join(stored_rows("metrics", every.alias("n_metrics")), "company_id")
