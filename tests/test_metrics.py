import math
import random

import pyarrow as pa

from ledgerleaf.operators import metrics

COLUMNS = ["company_id", "period", "metric_name", "metric_id", "value", "confidence_score"]


def order(row):
    """Null before all numbers and ids, NaN behind."""
    score, key = row[5], row[3]
    return (score is not None, (math.isnan(score), 0 if math.isnan(score) else score) if score is not None else (), key is not None, key or "")


def long_rows(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = None if i % 97 == 0 else f"é{rng.randint(0, 9)}_{i}"
        score = None if i % 89 == 0 else float("nan") if i % 1013 == 0 else rng.choice([0.7, 0.9, -0.0, 0.0])
        group = rng.choice(["a", "b", None]), rng.choice([None, "Q1 2024", "Q2 2024"]), rng.choice(["cac", "ltv"])
        rows.append((*group, key, None if i % 5 == 0 else float(i), score))
    return rows


def expected(rows):
    best = {}
    for row in rows:
        if row[:3] not in best or order(row) > order(best[row[:3]]):
            best[row[:3]] = row
    return best


def test_best_per_period(spark):
    rows = [r for r in long_rows(6000) if r[3] is not None]
    schema = "company_id string, period string, metric_name string, metric_id string, value double, confidence_score double"
    found = metrics.best_per_period(spark.createDataFrame(rows, schema).repartition(3)).collect()
    result = {tuple(r)[:3]: (r.value, repr(r.confidence_score)) for r in found}
    assert result == {k: (r[4], repr(r[5])) for k, r in expected(rows).items()}
    assert len(found) == len(result) == 18


def test_a_task_passes_on_few_rows(monkeypatch):
    """However many rows it reads; with fewer groups held at once the same rows are among them."""
    rows = [r for r in long_rows(30000) if r[5] is None or not math.isnan(r[5])]
    table = pa.table({c: pa.array(x) for c, x in zip(COLUMNS, zip(*rows))})
    batches = table.to_batches(max_chunksize=1000)
    found = [r for b in metrics.best_rows(iter(batches)) for r in b.to_pylist()]
    assert len(found) == 18
    best = expected(rows)
    assert {tuple(r[c] for c in COLUMNS[:3]): r["metric_id"] for r in found} == {k: r[3] for k, r in best.items()}
    monkeypatch.setattr(metrics, "_HELD", 4)
    again = [tuple(r[c] for c in COLUMNS) for b in metrics.best_rows(iter(batches)) for r in b.to_pylist()]
    assert len(again) > 18
    assert set(best.values()) <= set(again)


def test_cells_are_read_by_compiled_columns(spark):
    rows = [("c", "d", 0, i, 1, label, period, value) for i, (label, period, value) in enumerate([
        ("Total Revenue", "Q1 2024", "$1.2K"), ("Total Revenue", "Q1 2024", "n/a"), ("Notes", "Q1 2024", "3"),
        ("Net income", "Comment", "4"), (None, "Q1 2024", "5"), ("EBITDA", "Q1 2024", None), ("Headcount", "FY 2024", "(1,000)"),
    ])]
    cells = spark.createDataFrame(
        rows, "company_id string, document_id string, table_index int, row_index int, col_index int, row_label string, col_name string, value string"
    )
    found = metrics.table_metrics(cells)
    # A lambda would interpret all that is read from a cell.
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["metric_id"], r["metric_name"], r["value"]) for r in found.collect())
    assert got == [("d_0_0_1_Q1 2024", "revenue", 1200.0), ("d_0_6_1_FY 2024", "headcount", -1000.0)]
