"""Search against brute force, answers and generators."""

import importlib
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import answer, retrieve
from ledgerleaf.operators.generate import generate
from ledgerleaf.registry import inputs, queries
from ledgerleaf.session import stored_buckets
from ledgerleaf.sinks import tables

SF_DIR = "/root/testdata/sf0.001"
generate_module = importlib.import_module("ledgerleaf.operators.generate")


def frames(spark, n_chunks=700, n_queries=90, hot=0.5):
    pick = np.random.default_rng(5)
    vectors = pick.normal(size=(n_chunks, 8))
    vectors[100:200] = vectors[0]  # a group of copies
    company = np.where(pick.random(n_chunks) < hot, "hot", np.char.add("c", pick.integers(0, 9, n_chunks).astype(str)))
    chunks = [(f"k{i:04d}", str(company[i]), vectors[i].tolist()) for i in range(n_chunks)]
    asked = pick.normal(size=(n_queries, 8))
    asked[0] = vectors[0]
    scope = [None if i % 3 == 0 else str(pick.choice(["hot", "c1", "c2", "absent"])) for i in range(n_queries)]
    queries = [(f"q{i}", scope[i], asked[i].tolist()) for i in range(n_queries)]
    return (
        spark.createDataFrame(queries, "query_id string, company_id string, embedding array<double>"),
        spark.createDataFrame(chunks, "chunk_id string, company_id string, embedding array<double>"),
        queries,
        chunks,
    )


def brute_force(queries, chunks, k):
    def unit(v):
        return np.asarray(v) / np.linalg.norm(v)

    expected = {}
    for name, scope, vector in queries:
        scored = [
            (-round(float(unit(vector) @ unit(v)), 9), chunk) for chunk, company, v in chunks if scope in (None, company)
        ]
        for rank, (_, chunk) in enumerate(sorted(scored)[:k], 1):
            expected[name, rank] = chunk
    return expected


@pytest.mark.parametrize("options", [{}, {"max_shared_vectors": 5, "rows_per_task": 100}, {"max_shared_vectors": 5}])
@pytest.mark.parametrize("k", [1, 5])
def test_search_is_exact(spark, options, k):
    queries, chunks, asked, stored = frames(spark)
    rows = retrieve.search(queries, chunks.repartition(6), k, **options).collect()
    found = {(row["query_id"], row["rank"]): row["chunk_id"] for row in rows}
    assert found == brute_force(asked, stored, k)
    assert len(rows) == len(found)


def test_same_question_for_many_companies_is_one_vector(spark):
    _, chunks, _, _ = frames(spark)
    companies = chunks.select("company_id").distinct()
    queries = companies.select(
        F.concat(F.lit("q"), "company_id").alias("query_id"), "company_id", F.array(*[F.lit(1.0)] * 8).alias("embedding")
    )
    for limit in (1, 1000):
        rows = retrieve.search(queries, chunks, 2, max_shared_vectors=1, max_shared_companies=limit).collect()
        assert len(rows) == 2 * companies.count()


def texts(spark):
    rows = [
        ("d1_0", "a", "d1", "financial", "revenue was 5 million dollars"), ("d1_1", "a", "d1", "financial", "burn is high"),
        ("d2_0", "b", "d2", None, "the team has two founders"), ("d3_0", "c", "d3", "legal", ""),
    ]
    return spark.createDataFrame(rows, "chunk_id string, company_id string, document_id string, document_type string, text string")


def test_ask(spark):
    questions = spark.createDataFrame(
        [("1", "a", "what was revenue?"), ("2", "b", "who are the founders?"), ("3", "nobody", "what?"), ("4", None, "burn?")],
        "question_id string, company_id string, question string",
    )

    def echo(prompts):
        if any("founders?" in p for p in prompts):
            raise RuntimeError("refused")
        return [f" {p.split('Excerpts:')[1].split(chr(10))[2]} " for p in prompts]

    rows = {row["question_id"]: row for row in answer.ask(questions, texts(spark), echo, k=2).collect()}
    assert rows["1"]["answer"] == "revenue was 5 million dollars"
    assert rows["1"]["num_sources"] == 2 and rows["1"]["sources"][0]["document_id"] == "d1"
    assert rows["2"]["answer"] is None and rows["2"]["error"] == "refused"
    assert rows["3"]["answer"].startswith("I don't have enough information")
    assert (rows["3"]["confidence"], rows["3"]["sources"]) == (0.0, [])
    assert rows["4"]["answer"] == "burn is high"


def test_context_names_unknown_types(spark):
    found = texts(spark).withColumns({"question_id": F.lit("q"), "rank": F.lit(1), "score": F.lit(1.0)}).filter("company_id = 'b'")
    assert answer.context(found).first()["context"] == "[Document 1 - unknown]\nthe team has two founders"


@pytest.mark.parametrize("distinct", [True, False])
def test_generate(spark, distinct):
    prompts = ["a", "bad", "a", None, "c"] * 40
    frame = spark.createDataFrame(list(enumerate(prompts)), "id int, prompt string")

    def upper(batch):
        assert not distinct or len(set(batch)) == len(batch)
        if "bad" in batch:
            raise ValueError("bad prompt")
        return [p.upper() for p in batch]

    rows = generate(frame, "prompt", upper, distinct=distinct).collect()
    assert len(rows) == len(prompts)
    for row in rows:
        expected = {"a": ("A", None), "c": ("C", None), "bad": (None, "bad prompt"), None: (None, None)}[row["prompt"]]
        assert (row["reply"], row["error"]) == expected


def test_candidates_are_those_of_asked_pairs_only(spark):
    chunks = spark.range(20_000).selectExpr(
        "concat('k', id) AS chunk_id", "concat('c', id % 5000) AS company_id", "array(sin(id), cos(id), sin(id * 3.0)) AS embedding"
    ).repartition(4)
    vectors = [{"_vector": f"v{i}", "embedding": [np.sin(i + 0.5), np.cos(i), 0.3]} for i in range(200)]
    pairs = [{"_vector": f"v{i}", "company_id": f"c{i * 7}"} for i in range(200)]
    found = retrieve._shared_candidates(vectors, [], pairs, chunks, 3)
    # Each company has four chunks: at most so many candidates for each pair, of 4,000,000 pairs with all chunks.
    assert found.count() <= 4 * 200
    assert found.select("_vector", "_scope").distinct().count() == 200


def exchanged(frame):
    """Columns of each exchange of a plan."""
    plan, out = frame._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        if "Exchange" in name:
            out.append({a.name() for a in (node.output().apply(i) for i in range(node.output().length()))})
        children = node.children()
        for i in range(children.length()):
            walk(children.apply(i))

    walk(plan)
    return out


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_met_where_they_lie(spark, no_broadcasts):
    questions = queries.asked_questions(spark, SF_DIR)
    chunks = stored_buckets(inputs.document_chunks(spark, SF_DIR), "chunks", ["chunk_id"])
    found = retrieve.retrieve(questions, chunks, inputs.letter_embedding, k=3)
    columns = exchanged(found)
    assert columns and not any({"text", "embedding"} & names for names in columns)
    plain = retrieve.retrieve(questions, inputs.document_chunks(spark, SF_DIR).drop("created_at"), inputs.letter_embedding, k=3)
    assert any("text" in names for names in exchanged(plain))
    key = ["question_id", "rank", "chunk_id"]
    assert sorted(map(repr, found.select(*key, "text").collect())) == sorted(map(repr, plain.select(*key, "text").collect()))
    answered = queries.QUERIES["ask_batch"](spark, SF_DIR)
    assert not any({"text", "embedding", "context", "_prompt"} & names for names in exchanged(answered))


def test_vectors_are_met_where_they_lie(spark, no_broadcasts):
    found = queries.QUERIES["similarity_many_questions"](spark, SF_DIR)
    columns = exchanged(found)
    # Questions go to the slots; the vectors' side of the join is read in buckets.
    assert sum("embedding" in names and "chunk_id" in names for names in columns) == 0
    assert "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows_per_slot, questions_per_slot", [(50_000, 10_000), (7, 3)])
def test_slots_give_the_rows_of_blocks(spark, rows_per_slot, questions_per_slot):
    rng = np.random.default_rng(4)
    rows = [(f"k{i:03d}", "big" if i % 3 else f"c{i % 5}", np.round(rng.normal(size=4), 1).tolist()) for i in range(120)]
    rows += [("none", "big", None), ("zero", "big", [0.0] * 4)]
    chunks = spark.createDataFrame(rows, "chunk_id string, company_id string, embedding array<float>")
    asked = [(f"q{i}", ["big", "c0", "c1", "gone", None][i % 5], rng.normal(size=4).tolist()) for i in range(40)]
    asked = spark.createDataFrame(asked, "query_id string, company_id string, embedding array<float>")
    usable = chunks.filter("embedding IS NOT NULL")
    expected = retrieve.search(asked, usable, k=3, max_shared_vectors=1, rows_per_task=10).collect()
    placed = retrieve.with_slots(chunks, chunks, rows_per_slot=rows_per_slot)
    slots = placed.groupBy("company_id").agg(F.countDistinct("slot").alias("n")).collect()
    assert {r.company_id: r.n > 1 for r in slots}["big"] == (rows_per_slot < 50)
    placed = placed.filter("company_id IS NOT NULL")
    shared = [r for r in asked.collect() if r.company_id is not None]
    found = retrieve.search(
        asked.filter("company_id IS NOT NULL"), placed, k=3, max_shared_vectors=1, questions_per_slot=questions_per_slot
    ).collect()
    own = {r.query_id for r in shared}
    assert sorted(map(repr, found)) == sorted(map(repr, [r for r in expected if r.query_id in own]))


@pytest.mark.parametrize("share", [100_000, 2])
def test_replies_meet_rows_by_id(spark, monkeypatch, share):
    monkeypatch.setattr(generate_module, "ROWS_PER_SHARE", share)
    prompts = ["a"] * 9 + ["b", "bad", None, "c"]
    frame = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string")

    def upper(batch):
        if "bad" in batch:
            raise ValueError("bad prompt")
        return [p.upper() for p in batch]

    rows = generate(frame, "prompt", upper, row_id="id").collect()
    expected = {"a": ("A", None), "b": ("B", None), "c": ("C", None), "bad": (None, "bad prompt"), None: (None, None)}
    assert sorted(r.id for r in rows) == list(range(len(prompts)))
    assert all((r.reply, r.error) == expected[r.prompt] for r in rows)


def test_replies_outlive_a_run(spark, tmp_path):
    database = "replies_test"
    tables.create_tables(spark, database, ["generator_replies"])
    name = f"{database}.generator_replies"
    log = str(tmp_path / "log")

    def counted(batch):
        with open(log, "a") as out:
            out.write("".join(f"{p}\n" for p in batch))
        if "bad" in batch:
            raise ValueError("bad prompt")
        return [p.upper() for p in batch]

    def asked():
        lines = open(log).read().split() if os.path.exists(log) else []
        open(log, "w").close()
        return lines

    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)], "id long, prompt string")
    kept = tables.StoredReplies(spark, name, "m1")
    first = generate(frame, "prompt", counted, replies=kept, batch_size=1).collect()
    assert sorted(asked()) == ["a", "b", "bad"]
    again = generate(frame.union(frame.limit(1).withColumn("prompt", F.lit("new"))), "prompt", counted, replies=kept, row_id="id", batch_size=1)
    rows = generate(frame, "prompt", counted, replies=kept, row_id="id", batch_size=1).collect()
    assert "a" not in asked()
    assert sorted((r.id, r.reply) for r in rows) == sorted((r.id, r.reply) for r in first)
    assert {r.reply for r in again.collect()} == {"A", "B", "NEW", None}
    # Another model is asked itself.
    generate(frame, "prompt", counted, replies=tables.StoredReplies(spark, name, "m2"), batch_size=1).collect()
    assert sorted(asked()) == ["a", "b", "bad"]
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_letters_are_counted_in_one_pass(spark, monkeypatch):
    texts = [None, "", "ÀaİKz{`", "Zz" * 3000 + "q", "  ", "abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1)
    found = inputs.letter_embedding(rows)
    # Not a pass over the text for each letter.
    assert "replace(" not in found._jdf.queryExecution().executedPlan().toString()
    counted = {r["id"]: r["embedding"] for r in found.collect()}
    for number, text in enumerate(texts):
        lowered = (text or "").lower()
        assert counted[number] == [float(lowered.count(chr(97 + i))) for i in range(26)]
    # Pieces that end inside texts give the same counts, as do slices of a batch.
    whole = inputs.letter_counts(pa.array([(x or "").lower() for x in texts])).to_pylist()
    monkeypatch.setattr(inputs, "_COUNTED", 7)
    assert inputs.letter_counts(pa.array([(x or "").lower() for x in texts])).to_pylist() == whole
    assert inputs.letter_counts(pa.array(["xx"] + [(x or "").lower() for x in texts]).slice(1)).to_pylist() == whole
    assert inputs.letter_counts(pa.array([], pa.string())).to_pylist() == []
