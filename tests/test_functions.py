"""Literal cases of the scalar expressions."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import ids, numbers, text
from ledgerleaf.operators import classify, metrics, score


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_company_id(spark):
    assert value(spark, ids.company_id(F.lit("Acme Corp"))) == "feb27a647c4fec6d"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("$1,234", 1234.0), ("(1,234)", -1234.0), ("($5K)", -5000.0), ("25%", 0.25), ("€1.2M", 1200000.0), ("3b", 3e9),
        (" £7 ", 7.0), ("-5 %", -0.05), (".5", 0.5), ("1e3", 1000.0),
        ("12 months", None), ("-", None), ("n/a", None), ("5d", None), ("NaN", None), ("", None), (None, None), ("K", None),
    ],
)
def test_parse_amount(spark, raw, expected):
    result = value(spark, numbers.parse_amount(F.lit(raw).cast("string")))
    assert result == (None if expected is None else pytest.approx(expected))


@pytest.mark.parametrize("heading", ["Q1 2024", "FY24", "FY 2024", "2024", "Mar 2024", "ytd", "TTM", "q3 2021"])
def test_period_headings(spark, heading):
    assert value(spark, numbers.is_period(F.lit(heading)))


@pytest.mark.parametrize("heading", ["Notes", "Metric", "Q5", "FY"])
def test_other_headings(spark, heading):
    assert not value(spark, numbers.is_period(F.lit(heading)))


@pytest.mark.parametrize(
    ("label", "expected"),
    [
        ("Q3 2024", "2024-07-01"), ("2023-Q1", "2023-01-01"), ("FY24", "2024-01-01"), ("FY 2024", "2024-01-01"),
        ("Mar 2024", "2024-03-01"), ("2021", "2021-01-01"), ("YTD", None), ("TTM", None), ("Notes", None),
    ],
)
def test_period_key(spark, label, expected):
    result = value(spark, numbers.period_key(F.lit(label)))
    assert (None if result is None else str(result)) == expected


@pytest.mark.parametrize(
    ("label", "expected"),
    [
        ("EBITDA margin", "operating_margin"), ("Cash burn", "cash_balance"), ("Income after tax", "headcount"),
        ("Notes", None), ("Monthly burn", "burn_rate"), ("Adjusted EBITDA", "ebitda"),
    ],
)
def test_metric_of_label(spark, label, expected):
    assert value(spark, metrics.metric_of_label(F.lit(label))) == expected


def test_metric_of_label_by_word(spark):
    assert value(spark, metrics.metric_of_label(F.lit("Income after tax"), word_boundary=True)) is None
    assert value(spark, metrics.metric_of_label(F.lit("Total FTE"), word_boundary=True)) == "headcount"


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("financials/x.pdf", ("financial", 0.9)), ("misc/x.pdf", ("other", 0.0)), ("Pitch Deck/a.pdf", ("pitch_deck", 0.9)),
        ("a/legal_product.pdf", ("legal", 0.9)),
    ],
)
def test_folder_signal(spark, path, expected):
    assert tuple(value(spark, classify.folder_signal(F.lit(path)))) == expected


def test_filename_signal(spark):
    signal = classify.filename_signal(F.lit("Cap Table.pdf"), F.lit(None).cast("string"))
    assert tuple(value(spark, signal)) == ("legal", 0.4)


def test_scores_add_up_like_doubles(spark):
    """Three path hits are 0.2 + 0.2 + 0.2, a hair above two name hits of 0.3."""
    signal = classify.filename_signal(F.lit("a"), F.lit("product/roadmap/features"))
    assert value(spark, signal)["confidence"] == 0.2 + 0.2 + 0.2


def test_nothing_matches(spark):
    frame = spark.createDataFrame([("zzz.bin", "misc/zzz.bin")], "filename string, relative_path string")
    row = classify.classify(frame).first()
    assert (row["document_type"], row["classification_confidence"]) == ("other", 0.0)


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://e.com/a/b%20c+d.pdf?x=1", "b c+d.pdf"), ("https://e.com/r.pdf;v=2#top", "r.pdf"),
        ("https://e.com/", "document_20240102_030405.pdf"), ("https://e.com", "document_20240102_030405.pdf"),
        ("/local/100%.txt", "100%.txt"),
    ],
)
def test_url_filename(spark, url, expected):
    as_of = F.lit("2024-01-02 03:04:05").cast("timestamp")
    assert value(spark, text.url_filename(F.lit(url), as_of=as_of)) == expected


def test_header_filename(spark):
    header = F.lit('attachment; filename="r%C3%A9sum%C3%A9.pdf"')
    assert value(spark, text.url_filename(F.lit("https://e.com/x"), header)) == "résumé.pdf"


def test_strip_and_suffix(spark):
    assert value(spark, text.strip(F.lit(" \n\tx y "))) == "x y"
    assert value(spark, text.file_suffix(F.lit("a.tar.GZ"))) == ".gz"
    assert value(spark, text.file_suffix(F.lit("dir.d/.bashrc"))) == ""
    assert value(spark, text.title_case(F.lit("pitch_deck"))) == "Pitch Deck"


@pytest.mark.parametrize(("number", "digits", "expected"), [(0.25, 1, "0.2"), (0.35, 1, "0.3"), (2.5, 0, "2"), (1234.5, 1, "1234.5")])
def test_fixed_rounds_like_printf(spark, number, digits, expected):
    assert value(spark, numbers.fixed(F.lit(number), digits)) == expected


@pytest.mark.parametrize(
    ("points", "expected"),
    [(8.0, "strong_buy"), (7.999, "buy"), (7.0, "buy"), (5.0, "hold"), (4.999, "pass"), (0.0, "pass")],
)
def test_recommendation(spark, points, expected):
    assert value(spark, score.recommendation(F.lit(points))) == expected


NEUTRAL = (5.0, "Unable to fully analyze this dimension.", [])


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ('{"score": 8, "reasoning": "r", "key_findings": ["a"]}', (8.0, "r", ["a"])),
        ('text ```json\n{"score": "8.5"}\n``` more', (8.5, "", [])),
        ('```\n{"reasoning": "only"}\n```', (5.0, "only", [])),
        ('```json\n{"score": 3}', (3.0, "", [])),
        ('{"score": 8} and more', NEUTRAL), ('{"score": 8}, {"score": 9}', NEUTRAL), ("{'score': 8}", NEUTRAL), ('{"score": "8d"}', NEUTRAL),
        (' \n{"score": " 7 ", "reasoning": "é"} ', (7.0, "é", [])), ("{}", (5.0, "", [])),
        ('{"score": null}', NEUTRAL), ('{"score": "high"}', NEUTRAL), ("no json", NEUTRAL), ("[1, 2]", NEUTRAL), ("", NEUTRAL),
        (None, NEUTRAL),
    ],
)
def test_parse_reply(spark, reply, expected):
    row = value(spark, score.parse_reply(F.lit(reply).cast("string")))
    assert (row["score"], row["reasoning"], row["key_findings"]) == expected


def _card(spark, scores):
    rows = [("c", i, f"d{i}", 20, s, "r", ["x", "y", "z"]) for i, s in enumerate(scores)]
    schema = "company_id string, ord int, dimension string, weight int, score double, reasoning string, key_findings array<string>"
    return score.scorecard(spark.createDataFrame(rows, schema)).first()


def test_confidence_bounds(spark):
    assert _card(spark, [6.0] * 5)["confidence_level"] == 1.0
    assert _card(spark, [0.0, 10.0])["confidence_level"] == 0.0


def test_lists_are_short(spark):
    card = _card(spark, [9.0, 9.0, 9.0, 5.0, 5.0])
    assert card["key_opportunities"] == ["x", "y", "x", "y", "x"]
    assert [d["dimension"] for d in card["top_dimensions"]] == ["d0", "d1", "d2"]
    assert card["recommendation"] == "buy"
    assert card["next_steps"][-1] == "Prepare term sheet and valuation analysis"
    assert len(card["next_steps"]) == 5


def test_html(spark):
    html = "<title>A &amp; B</title><style>p{}</style><p>x<br>y&nbsp;&lt;z&gt;</p><!-- no --><script>var t='<p>'</script>"
    assert value(spark, text.html_title(F.lit(html))) == "A & B"
    assert value(spark, text.html_text(F.lit(html))) == "A & B x y <z>"


def test_two_digit_years_have_a_pivot(spark):
    labels = ["FY95", "FY99", "FY70", "FY69", "FY01", "FY 24"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string").select("label", numbers.period_key("label").alias("k")).collect()
    assert {r.label: r.k.year for r in rows} == {"FY95": 1995, "FY99": 1999, "FY70": 1970, "FY69": 2069, "FY01": 2001, "FY 24": 2024}
    assert rows[0].k.isoformat() == "1995-01-01"
    early = spark.createDataFrame([("FY95",)], "label string").select(numbers.period_key("label", pivot_year=99)).first()[0]
    assert early.year == 2095


def test_equal_headings_keep_both_values(spark):
    cells = spark.createDataFrame(
        [("c", "d", 0, 1, i, "Revenue", "Q1 2024", v) for i, v in ((1, "$1M"), (2, "$2M"))],
        "company_id string, document_id string, table_index int, row_index int, col_index int, row_label string, col_name string, value string",
    )
    rows = metrics.table_metrics(cells).collect()
    assert len({r.metric_id for r in rows}) == 2
    assert {r.value for r in rows} == {1e6, 2e6}


def test_growth_of_periods(spark):
    from ledgerleaf.operators import metrics

    rows = [
        ("a", "Q1 2024", 100.0), ("a", "Q3 2024", 300.0), ("a", "2019", 0.0), ("a", "FY20", 50.0), ("a", None, 7.0), ("a", "TTM", 9.0),
        ("b", "Q1 2024", None), ("b", "Q2 2024", 10.0),
    ]
    bases = [n for n in metrics.PERIOD_BASES if n != "revenue"]
    frame = spark.createDataFrame(rows, "company_id string, period string, revenue double")
    frame = frame.withColumns({n: F.when(F.col("company_id") == "a", 4.0 if n == "cac" else 8.0) for n in bases})
    grown = {(r.company_id, r.period): r for r in metrics.period_growth(frame).collect()}
    assert grown["a", "Q1 2024"].revenue_growth_rate == 1.0
    assert grown["a", "Q3 2024"].revenue_growth_rate == 2.0
    assert grown["a", "FY20"].revenue_growth_rate is None and grown["a", "2019"].revenue_growth_rate is None
    assert grown["a", None].revenue_growth_rate is None and grown["a", "TTM"].revenue_growth_rate is None
    assert grown["b", "Q2 2024"].revenue_growth_rate is None
    assert (grown["a", "TTM"].ltv_cac_ratio, grown["a", "TTM"].runway_months) == (2.0, 1.0)
    late = metrics.merged_periods(frame.unionByName(frame.limit(1).withColumns({"period": F.lit("Q2 2024"), "revenue": F.lit(150.0)})))
    grown = {(r.company_id, r.period): r.revenue_growth_rate for r in metrics.period_growth(late).collect()}
    assert (grown["a", "Q2 2024"], grown["a", "Q3 2024"], grown["a", "Q1 2024"]) == (0.5, 1.0, 1.0)
