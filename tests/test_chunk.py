"""Chunks against a plain loop, and their properties."""

import random

from pyspark.sql import functions as F

from ledgerleaf.operators.chunk import add_section_title, as_of, chunk, heading_offsets, page_at, title_at

ENDS = (". ", ".\n", "! ", "!\n", "? ", "?\n")


def plain_chunks(body, size=800, overlap=200):
    if not body or len(body) < size:
        return [(0, 0, body)]
    found, start, index = [], 0, 0
    while start < len(body):
        end = start + size
        if end < len(body):
            low, high = max(end - 100, start), min(end + 100, len(body))
            end = next((i + 1 for i in range(low, high) if body[i : i + 2] in ENDS), end)
        if body[start:end].strip():
            found.append((index, start, body[start:end].strip()))
        start, index = end - overlap, index + 1
    return found


def made(spark, bodies, **options):
    frame = spark.createDataFrame(list(enumerate(bodies)), "document_id int, text string")
    rows = chunk(frame, **options).collect()
    result = {i: [] for i in range(len(bodies))}
    for row in rows:
        result[row["document_id"]].append((row["chunk_index"], row["chunk_start"], row["text"]))
    return [sorted(result[i], key=lambda c: c[0]) for i in range(len(bodies))]


def bodies():
    pick = random.Random(7)
    alphabet = ["word", "é", "😀", " ", "  ", ". ", "! ", "?\n", ".\n", "\n", "x" * 90, " ", "."]
    texts = ["".join(pick.choices(alphabet, k=pick.randint(1, 1500))) for _ in range(40)]
    edge = [None, "", "x" * 799, "x" * 800, "x" * 1300, " " * 5000 + "a", "😀. " * 3000, "z" * 40000 + ". " + "q" * 40000]
    return texts + edge + [("word " * 30 + ". ") * 3000]


def test_equals_a_plain_loop(spark):
    texts = bodies()
    for body, chunks in zip(texts, made(spark, texts)):
        assert chunks == plain_chunks(body)


def test_other_sizes(spark):
    texts = bodies()
    for body, chunks in zip(texts, made(spark, texts, size=400, overlap=50)):
        assert chunks == plain_chunks(body, 400, 50)


def test_all_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text")
    texts = [row["text"] for row in documents.collect()]
    for body, chunks in zip(texts, made(spark, texts)):
        assert chunks == plain_chunks(body)
        assert all(len(c[2]) <= 900 for c in chunks)


def test_options(spark):
    [limited] = made(spark, ["x" * 10000], max_chunks=3)
    assert [c[0] for c in limited] == [0, 1, 2]
    [trimmed] = made(spark, ["x" * 1300], drop_contained_tail=True)
    assert [len(c[2]) for c in trimmed] == [800, 700]


def test_section_titles(spark):
    body = "intro\n# First\n" + "a" * 1000 + "\n## Second part ##\n" + "b" * 1000
    frame = spark.createDataFrame([("d", body)], "document_id string, text string")
    rows = add_section_title(chunk(frame.withColumn("headings", heading_offsets("text")))).orderBy("chunk_start")
    titles = [(row["chunk_start"], row["section_title"]) for row in rows.select("chunk_start", "section_title").collect()]
    assert titles == [(0, None), (600, "First"), (1200, "Second part"), (1800, "Second part")]


def test_no_shuffle(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    plan = chunk(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_as_of(spark):
    import bisect
    import random

    rng = random.Random(1)
    rows = [(sorted(rng.sample(range(500), n)), rng.randrange(-5, 505)) for n in (0, 1, 2, 3, 7, 8, 100, 255, 256, 257) for _ in range(20)]
    frame = spark.createDataFrame(rows, "starts array<int>, at int")
    found = frame.select("starts", "at", as_of(F.col("starts"), F.col("at")).alias("n")).collect()
    assert all(r.n == bisect.bisect_right(r.starts, r.at) for r in found)
    placed = frame.select("starts", page_at("starts")(F.col("at")).alias("page")).collect()
    assert all((r.page is None) == (not r.starts) and (r.page or 1) >= 1 for r in placed)


def test_places_equal_the_columns_added_afterwards(spark):
    text = "# One\n" + "Words follow here. " * 90 + "\n## Two\n" + "More of them! " * 120
    frame = spark.createDataFrame([("d", text, [0, 900, 2000]), ("e", "short", [0]), ("f", None, None)], "document_id string, text string, page_starts array<int>")
    frame = frame.withColumn("headings", heading_offsets("text"))
    after = add_section_title(chunk(frame)).drop("page_starts", "headings")
    places = {"page_number": page_at(), "section_title": title_at()}
    inside = chunk(frame, places=places, drop=("page_starts", "headings"))
    assert sorted(map(repr, inside.drop("page_number").collect())) == sorted(map(repr, after.select(*inside.drop("page_number").columns).collect()))
    pages = {(r.document_id, r.chunk_start): r.page_number for r in inside.collect()}
    assert all(p == (None if d == "f" else sum(x <= at for x in ([0, 900, 2000] if d == "d" else [0]))) for (d, at), p in pages.items())
