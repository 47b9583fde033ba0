"""Exact similarity search with an optional company filter, for many questions at once.

Scores are cosines, computed block-wise inside tasks; candidates are cut to ``k`` per question and company
where they arise, so the shuffle carries only possible answers. Scores equal to nine decimals are ties and
fall to the smaller chunk id, which keeps results independent of how rows are split.

Texts and vectors stay where they are written: few question vectors go to all vectors; many meet the vectors in
their slots, which hold a bounded number of one company's, in tables that are bucketed by slot; and what was found
meets the texts by id in a table that is bucketed by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.constants import ANSWER_TOP_K

# Distinct question vectors sent to every task: 1,024 vectors of 1,024 doubles are 8 MB.
MAX_SHARED_VECTORS = 1024
MAX_SHARED_PAIRS = 200_000
# Company ids of at most this many asked companies are broadcast to filter the chunks.
MAX_SHARED_COMPANIES = 10_000
# Vectors of a slot, and questions that are put to a slot at once.
ROWS_PER_SLOT = 50_000
QUESTIONS_PER_SLOT = 10_000
_DIGITS = 9
_BLOCK_ROWS = 256

Embedder = Callable[[DataFrame, str, str], DataFrame]


def hashed_embedding(df: DataFrame, text: str = "text", out: str = "embedding", dimensions: int = 256) -> DataFrame:
    """Offline embedder: normalised term counts hashed into ``dimensions`` buckets."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\W+"), lambda word: F.length(word) > 0)
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions).transform(
        df.withColumn("_words", words)
    )
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")


def _unit_rows(vectors: list) -> np.ndarray:
    matrix = np.asarray(vectors, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best_rows(scores: np.ndarray, groups: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best rows of each group: highest score, then smallest ``order``."""
    ranked = np.lexsort((order, -scores, groups))
    sorted_groups = groups[ranked]
    first = np.r_[True, sorted_groups[1:] != sorted_groups[:-1]]
    starts = np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))
    return ranked[np.arange(len(ranked)) - starts < k]


def _best_per_batch(
    ids: np.ndarray, chunks: np.ndarray, vectors: np.ndarray, names: np.ndarray, groups: np.ndarray, k: int
) -> pd.DataFrame:
    scores = np.round(chunks @ vectors.T, _DIGITS)
    order = np.argsort(np.argsort(ids))
    picked = [_best_rows(scores[:, v], groups, order, k) for v in range(len(vectors))]
    rows = np.concatenate(picked)
    column = np.repeat(np.arange(len(vectors)), [len(p) for p in picked])
    return pd.DataFrame({"_vector": names[column], "_row": rows, "score": scores[rows, column]})


def _ranked(candidates: DataFrame, keys: list[str], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("chunk_id"))
    return candidates.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _matrix(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    names = np.array([row["_vector"] for row in vectors], dtype=object)
    return names, _unit_rows([row["embedding"] for row in vectors]) if vectors else np.zeros((0, 0))


def _shared_candidates(filtered: list, unfiltered: list, pairs: list, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best chunks of a batch: of each company for the vectors that asked it (``pairs``), and of all, with
    scope '', for the unfiltered vectors. Companies that nobody asked about are not scored."""
    of_company, of_all = _matrix(filtered), _matrix(unfiltered)
    place = {name: i for i, name in enumerate(of_company[0])}
    asked_of: dict[str, list[int]] = {}
    for pair in pairs:
        asked_of.setdefault(pair["company_id"], []).append(place[pair["_vector"]])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            ids = batch["chunk_id"].to_numpy()
            data = _unit_rows(batch["embedding"].tolist())
            if filtered:
                codes, names = pd.factorize(batch["company_id"], use_na_sentinel=False)
                order = np.argsort(codes, kind="stable")
                edges = np.searchsorted(codes[order], np.arange(len(names) + 1))
                for name, start, stop in zip(names, edges[:-1], edges[1:]):
                    if name in asked_of:
                        rows, own = order[start:stop], asked_of[name]
                        groups = np.zeros(len(rows), dtype=np.int64)
                        best = _best_per_batch(ids[rows], data[rows], of_company[1][own], of_company[0][own], groups, k)
                        row = best.pop("_row").to_numpy()
                        yield best.assign(_scope=name, chunk_id=ids[rows][row])
            if unfiltered:
                best = _best_per_batch(ids, data, of_all[1], of_all[0], np.zeros(len(ids), dtype=np.int64), k)
                row = best.pop("_row").to_numpy()
                yield best.assign(_scope="", chunk_id=ids[row])

    return chunks.select("chunk_id", "company_id", "embedding").mapInPandas(
        score, "_vector string, score double, _scope string, chunk_id string"
    )


def _search_shared(filtered: list, unfiltered: list, pairs: list, chunks: DataFrame, k: int) -> DataFrame:
    """Score chunks against few vectors, in one pass over the chunks and without shuffling them.

    Gives ``_vector, _scope, rank, chunk_id, score``: the ``k`` best of each company for the vectors that asked it,
    and the ``k`` best of all, with scope '', for the others.
    """
    return _ranked(_shared_candidates(filtered, unfiltered, pairs, chunks, k), ["_vector", "_scope"], k)


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows packed into blocks of at most 256 of one scope: ``_scope, ids, data``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("_scope", sort=False):
                for start in range(0, len(part), _BLOCK_ROWS):
                    block = part.iloc[start : start + _BLOCK_ROWS]
                    data = _unit_rows(block["embedding"].tolist())
                    yield pd.DataFrame(
                        {"_scope": [name], "ids": [block["_key"].tolist()], "data": [data.tobytes()]}
                    )

    # Sorted within tasks, so that blocks of small companies are not cut by others between their rows.
    sorted_rows = rows.select(F.col(key).cast("string").alias("_key"), "_scope", "embedding").sortWithinPartitions("_scope")
    return sorted_rows.mapInPandas(
        pack, "_scope string, ids array<string>, data binary"
    )


def with_slots(vectors: DataFrame, rows: DataFrame, keys: Sequence[str] = ("company_id",), rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """``vectors`` with the ``slot`` of each: those of a company (and of whatever else is in ``keys``) are split into as many
    as their number asks for. They are counted in ``rows``, which has the same keys and need not hold vectors."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    # Companies of one slot, nearly all, are not listed: at most rows / rows_per_slot others are.
    split = sizes.filter(F.col("_rows") > rows_per_slot).select(*keys, F.ceil(F.col("_rows") / rows_per_slot).alias("_parts"))
    large = split.collect()
    part = F.lit(0).cast("long")
    if large:
        listed = vectors.sparkSession.createDataFrame(large, split.schema)
        vectors = vectors.join(F.broadcast(listed), list(keys), "left")
        part = F.pmod(F.xxhash64("chunk_id"), F.coalesce("_parts", F.lit(1)))
    return vectors.withColumn("slot", F.xxhash64(*keys, part)).drop("_parts")


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of an Arrow table (ids first, embeddings last), without those that are null."""
    table = table.filter(pc.is_valid(table.column(table.num_columns - 1)))
    ids = table.column(0).to_pandas().to_numpy()
    lists = table.column(table.num_columns - 1).combine_chunks()
    data = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    return ids, _unit_rows(data)


def _search_slots(queries: DataFrame, chunks: DataFrame, k: int, questions_per_slot: int) -> DataFrame:
    """Many vectors asked of companies: questions go to the slots of their company, and the ``k`` best leave each. No vector
    is moved if the chunks are a table bucketed by company and slot."""
    # Questions may come from the same table: their columns have names of their own.
    slots = chunks.select(F.col("company_id").alias("_company"), F.col("slot").alias("_slot")).distinct()
    asked = queries.select("query_id", "embedding", F.col("company_id").alias("_company")).join(slots, "_company")
    busiest = asked.groupBy("_company", "_slot").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = max(1, math.ceil(busiest / questions_per_slot))

    def score(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        out = [pd.DataFrame({"query_id": [], "score": [], "chunk_id": []}).astype({"score": float})]
        names, right = _rows_of(questions.select(["query_id", "embedding"]))
        ids, data = _rows_of(vectors.select(["chunk_id", "embedding"]))
        for at in range(0, len(ids) if len(names) else 0, 4096):
            own = ids[at : at + 4096]
            groups = np.zeros(len(own), dtype=np.int64)
            for q in range(0, len(names), 1024):
                best = _best_per_batch(own, data[at : at + 4096], right[q : q + 1024], names[q : q + 1024], groups, k)
                row = best.pop("_row").to_numpy()
                out.append(best.rename(columns={"_vector": "query_id"}).assign(chunk_id=own[row]))
            if len(out) > 64:
                out = [_cut(pd.concat(out), k)]
        kinds = pa.schema([("query_id", pa.string()), ("score", pa.float64()), ("chunk_id", pa.string())])
        return pa.Table.from_pandas(_cut(pd.concat(out), k), schema=kinds, preserve_index=False)

    found = None
    for number in range(rounds):
        now = asked if rounds == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == number)
        own = chunks.select("chunk_id", "company_id", "slot", "embedding").groupBy("company_id", "slot")
        met = own.cogroup(now.groupBy("_company", "_slot"))
        part = met.applyInArrow(score, "query_id string, score double, chunk_id string")
        found = part if found is None else found.unionByName(part)
    return _ranked(found, ["query_id"], k).select("query_id", "rank", "chunk_id", "score")


def _cut(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each question, smaller ids first among equal scores."""
    return found.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


def _search_blocks(queries: DataFrame, chunks: DataFrame, k: int, rows_per_task: int, by_company: bool) -> DataFrame:
    """Many vectors: blocks of chunks meet blocks of questions, of the same company if asked.

    More than ``rows_per_task`` chunks (of a company) are split: the chunk blocks go to as many keys as
    their number asks for and the question blocks to all of these. Only the ``k`` best of a pair of blocks leave it.
    """
    chunk_blocks, query_blocks = _blocks(chunks, "chunk_id"), _blocks(queries, "query_id")
    if by_company:
        sizes = chunks.groupBy("_scope").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > rows_per_task)
        split = sizes.select("_scope", F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_parts"))
        chunk_blocks = chunk_blocks.join(split, "_scope", "left")
        query_blocks = query_blocks.join(split, "_scope", "left")
        parts, keys = F.coalesce("_parts", F.lit(1)), ["_scope", "_part"]
    else:
        parts, keys = F.lit(max(1, math.ceil(chunks.count() / rows_per_task))), ["_part"]
    chunk_blocks = chunk_blocks.withColumn("_part", F.pmod(F.xxhash64("ids"), parts).cast("int"))
    query_blocks = query_blocks.select(
        "_scope",
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"),
        F.col("ids").alias("query_ids"),
        F.col("data").alias("query_data"),
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, data, query_ids, query_data in batch.itertuples(index=False, name=None):
                ids = np.asarray(ids, dtype=object)
                names = np.asarray(query_ids, dtype=object)
                left = np.frombuffer(data).reshape(len(ids), -1)
                right = np.frombuffer(query_data).reshape(len(names), -1)
                best = _best_per_batch(ids, left, right, names, np.zeros(len(ids), dtype=np.int64), k)
                row = best.pop("_row").to_numpy()
                yield best.rename(columns={"_vector": "query_id"}).assign(chunk_id=ids[row])

    candidates = (
        chunk_blocks.join(query_blocks, keys)
        .select("ids", "data", "query_ids", "query_data")
        .mapInPandas(score, "query_id string, score double, chunk_id string")
    )
    return _ranked(candidates, ["query_id"], k).select("query_id", "rank", "chunk_id", "score")


def search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = ANSWER_TOP_K,
    max_shared_vectors: int = MAX_SHARED_VECTORS,
    max_shared_companies: int = MAX_SHARED_COMPANIES,
    rows_per_task: int = 500_000,
    max_shared_pairs: int = MAX_SHARED_PAIRS,
    questions_per_slot: int = QUESTIONS_PER_SLOT,
) -> DataFrame:
    """``query_id, rank, chunk_id, score`` of the ``k`` chunks most similar to each question.

    ``queries`` has ``query_id, company_id, embedding``, ``chunks`` has ``chunk_id, company_id, embedding``.
    A question with a company sees that company's chunks only, one without sees all. The same vector asked
    of many companies counts once: up to ``max_shared_vectors`` distinct ones, asked in up to ``max_shared_pairs`` pairs
    of vector and company, go to the chunks. More of them go to the slots of their companies, if ``chunks`` has a
    ``slot`` (see ``with_slots``), else both meet in a join of blocks. All ways give the same rows, and none scores a
    company against vectors that did not ask it.
    """
    has_company = F.col("company_id").isNotNull()
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "company_id", "embedding").withColumns(
        {"_vector": F.md5(F.to_json("embedding")), "_scope": F.coalesce("company_id", F.lit(""))}
    )
    # One vector more than allowed is enough to know that there are too many.
    vectors = (
        asked.groupBy("_vector", has_company.alias("_filtered"))
        .agg(F.any_value("embedding").alias("embedding"))
        .limit(max_shared_vectors + 1)
        .collect()
    )
    pairs = (
        asked.filter(has_company).select("_vector", "company_id").distinct().limit(max_shared_pairs + 1).collect()
        if len(vectors) <= max_shared_vectors
        else []
    )
    if len(vectors) <= max_shared_vectors and len(pairs) <= max_shared_pairs:
        filtered = [row for row in vectors if row["_filtered"]]
        unfiltered = [row for row in vectors if not row["_filtered"]]
        corpus = chunks
        if not unfiltered:
            companies = asked.select("company_id").distinct()
            # Few companies: other chunks are left out early. Many: the filter would cost a shuffle of all
            # embeddings and the last join drops what nobody asked for anyway.
            if companies.limit(max_shared_companies + 1).count() <= max_shared_companies:
                corpus = chunks.join(F.broadcast(companies), "company_id", "left_semi")
        best = _search_shared(filtered, unfiltered, pairs, corpus, k)
        return asked.join(best, ["_vector", "_scope"]).select("query_id", "rank", "chunk_id", "score")
    sides = []
    if not asked.filter(has_company).isEmpty():
        if "slot" in chunks.columns:
            sides.append(_search_slots(asked.filter(has_company), chunks, k, questions_per_slot))
        else:
            of_company = chunks.filter(has_company).withColumn("_scope", F.col("company_id"))
            sides.append(_search_blocks(asked.filter(has_company), of_company, k, rows_per_task, True))
    if not asked.filter(~has_company).isEmpty():
        sides.append(_search_blocks(asked.filter(~has_company), chunks.withColumn("_scope", F.lit("")), k, rows_per_task, False))
    return reduce(DataFrame.unionByName, sides)


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    embed: Embedder = hashed_embedding,
    k: int = ANSWER_TOP_K,
    embeddings: DataFrame | None = None,
) -> DataFrame:
    """Chunks for questions in words: ``question_id, rank, score`` and the chunk's columns.

    ``questions`` has ``question_id, company_id, question``. ``embeddings`` (``chunk_id, company_id,
    embedding`` and ``slot``, if known) saves embedding the chunks again. If ``chunks`` is a table bucketed by
    ``chunk_id``, no text is moved but those found.
    """
    queries = embed(questions, "question", "embedding").withColumnRenamed("question_id", "query_id")
    vectors = embed(chunks.select("chunk_id", "company_id", "text"), "text", "embedding") if embeddings is None else embeddings
    found = search(queries, vectors, k).withColumnRenamed("query_id", "question_id")
    return found.join(chunks.select("chunk_id", "company_id", "document_id", "document_type", "text"), "chunk_id")
