"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

An item's terms are taken rarest first. Documents that hold one of the first terms get an accumulator (a partial score);
once the greatest score that the remaining terms could give together is below the kth score reached so far, no further
accumulators are made: a document without one cannot be among the k best any more. The remaining terms only update the
accumulators there are, exactly, and those that cannot reach the kth score drop out on the way.

Spark: the texts are read once and become stored postings by document (its length, the terms asked for and how often it
holds them), so that an accumulator of an item and a document lives beside that document's postings and is never
shuffled. A round takes a number of terms of every open item in all documents; the leaders of each task, brought up to
date with all their terms, give the kth score of the round. Only leaders and final results leave a task. Lengths,
document frequencies and the greatest impact of each term are counted over all documents. Items come in blocks of a
bounded number of terms, so that neither the driver nor a task holds all of them; one document and one item are whole.

Words are found by 64-bit hashes and then compared byte by byte.

Defined cases: null texts and texts without terms are neither counted nor found; an item without terms, or whose terms
no document holds, has no rows; equal scores are ordered by document id, null ids last; rows with equal ids or texts are
documents (or items) of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import RangeHash, sized, slices, stored, texts_of

BEST = 10
# Terms of an item whose documents get accumulators in the first round; each further round takes twice as many.
FIRST_TERMS = 8
# Pairs of an item and a term that are held at once.
BLOCK_TERMS = 200_000
# Postings that array code handles at once, and terms by which accumulators are updated before some drop out.
STEP_POSTINGS, STEP_TERMS = 200_000, 4
_POOL = 50_000

# Bytes of digits, letters and other scripts; capital letters become small, all else a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    # Only blanks separate here: other white space has become blanks.
    return text.translate(_FOLD).split()


class Vocabulary:
    """The terms asked for, found in a buffer by hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms]).astype(np.int64) if terms else np.zeros(0, np.int64)
        starts = np.concatenate(([0], ends[:-1])) if terms else ends
        hashes = RangeHash().load(self.data).of(starts, ends) if terms else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.ends = hashes[self.order], starts[self.order], ends[self.order]
        # How many terms share a hash, at most.
        self.shared = int(np.unique(hashes, return_counts=True)[1].max(initial=0))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: RangeHash) -> np.ndarray:
        """The number of each range's term, or -1."""
        found = np.full(len(starts), -1, np.int64)
        if not len(self) or not len(starts):
            return found
        hashes = hasher.load(data).of(starts, ends)
        first = np.searchsorted(self.hashes, hashes)
        for more in range(self.shared):
            at = first + more
            own = np.minimum(at, len(self) - 1)
            word = np.flatnonzero((at < len(self)) & (self.hashes[own] == hashes) & (found < 0))
            term = own[word]
            length = ends[word] - starts[word]
            same = length == self.ends[term] - self.starts[term]
            word, term, length = word[same], term[same], length[same]
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                step = max(1, 1_000_000 // int(n))
                for a in range(0, len(rows), step):
                    some = rows[a : a + step]
                    offsets = np.arange(n)
                    equal = data[starts[word[some], None] + offsets] == self.data[self.starts[term[some], None] + offsets]
                    some = some[equal.all(axis=1)]
                    found[word[some]] = self.order[term[some]]
        return found


def postings(docs: DataFrame, vocabulary: Vocabulary, id_column: str, text_column: str) -> DataFrame:
    """Rows (doc, n, terms, counts) of the documents with a term: their length in terms, the numbers of the terms of the
    vocabulary that they hold, ascending, and how often."""
    kind = docs.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RangeHash()
        for batch in slices(batches, "text"):
            folded = [x.translate(_FOLD) for x in texts_of(batch, "text")]
            data = np.frombuffer(b" ".join(folded) + b" ", np.uint8)
            bounds = np.cumsum([0] + [len(x) + 1 for x in folded])
            letter = np.concatenate(([0], (data != 32).view(np.int8), [0]))
            edges = np.flatnonzero(np.diff(letter))
            starts, ends = edges[::2], edges[1::2]
            text = np.searchsorted(bounds, starts, side="right") - 1
            n = np.bincount(text, minlength=len(folded))
            term = vocabulary.find(data, starts, ends, hasher)
            hit = term >= 0
            pairs, counts = np.unique(text[hit] * max(1, len(vocabulary)) + term[hit], return_counts=True)
            own, term = np.divmod(pairs, max(1, len(vocabulary)))
            kept = np.flatnonzero(n)
            sizes = np.bincount(own, minlength=len(folded))[kept]
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept)), pa.array(n[kept].astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
                ],
                ["doc", "n", "terms", "counts"],
            )

    rows = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    return rows.mapInArrow(count, f"doc {kind}, n long, terms array<int>, counts array<int>")


@dataclass
class Plan:
    """Terms of the items of a block, rarest first: ``first[i] : first[i + 1]`` are those of item i."""

    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    # Greatest score that this term and all later ones of the item can give together; one more at each item's end, 0.
    rest: np.ndarray
    documents: int
    length: int
    vocabulary: int

    def terms(self) -> np.ndarray:
        return np.diff(self.first)

    def rest_of(self, item: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return self.rest[self.first[item] + item + rank]

    def stops(self, least: np.ndarray) -> np.ndarray:
        """Number of terms after which an item's remaining ones cannot reach its kth score."""
        item = np.repeat(np.arange(len(least)), self.terms() + 1)
        return np.bincount(item, self.rest >= np.maximum(least, 1)[item], minlength=len(least)).astype(np.int64)


def _plan(rows: DataFrame, items: list[list[int]], terms: int) -> Plan:
    """Count lengths, document frequencies and impacts over all documents, and order the items' terms."""
    documents, length = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    length = length or 0
    used = np.zeros(terms, np.int64)
    top = np.zeros(terms, np.int64)
    if length:
        of_length = F.expr(f"10 + (90L * n * {documents}L) div {length}L")
        found = rows.select(of_length.alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        found = found.select("m", F.col("p.terms").alias("term"), F.col("p.counts").cast("long").alias("tf"))
        impact = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
        for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(impact).alias("top")).collect():
            used[r.term], top[r.term] = r.df, r.top
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in used]
    first, order, rest = [0], [], []
    for own in items:
        own = sorted((t for t in own if used[t]), key=lambda t: (used[t], t))
        order += own
        first.append(len(order))
        ahead = [0]
        for t in reversed(own):
            ahead.append(ahead[-1] + weight[t] * int(top[t]))
        rest += reversed(ahead)
    term = np.array(order, np.int64)
    return Plan(np.array(first), term, np.array(weight, np.int64)[term], np.array(rest, np.int64), documents, length, terms)


class Evaluation:
    """Accumulators of all items over some documents' postings."""

    def __init__(self, plan: Plan, made: np.ndarray, least: np.ndarray) -> None:
        self.plan, self.made, self.least = plan, made, least
        # Items by term, of the terms that make accumulators.
        item = np.repeat(np.arange(len(made)), plan.terms())
        rank = np.arange(len(item)) - plan.first[item]
        making = np.flatnonzero(rank < made[item])
        making = making[np.argsort(plan.term[making], kind="stable")]
        self.item, self.weight = item[making], plan.weight[making]
        self.by_term = np.searchsorted(plan.term[making], np.arange(plan.vocabulary + 1))

    def load(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, counts: np.ndarray) -> None:
        plan = self.plan
        self.size = len(n)
        self.doc = np.repeat(np.arange(self.size), sizes)
        self.term = term.astype(np.int64)
        m = 10 + (90 * n * plan.documents) // plan.length
        tf = counts.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        self.keys = self.doc * plan.vocabulary + self.term

    def accumulators(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, partial score) of the documents that hold a term which makes accumulators."""
        many = self.by_term[self.term + 1] - self.by_term[self.term]
        posting = np.repeat(np.arange(len(many)), many)
        at = self.by_term[self.term][posting] + np.arange(len(posting)) - np.repeat(np.cumsum(many) - many, many)
        key = self.item[at] * self.size + self.doc[posting]
        score = self.weight[at] * self.impact[posting]
        order = np.argsort(key, kind="stable")
        key, score = key[order], score[order]
        begin = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))[: len(key)]
        item, doc = np.divmod(key[begin], max(1, self.size))
        return item, doc, np.add.reduceat(score, begin) if len(key) else score

    def update(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The accumulators after all remaining terms, without those that fall behind the kth score."""
        plan = self.plan
        rank = self.made[item]
        last = len(self.keys) - 1
        while True:
            left = score + plan.rest_of(item, rank) >= np.maximum(self.least[item], 1)
            item, doc, score, rank = item[left], doc[left], score[left], rank[left]
            if not len(item) or (rank >= plan.terms()[item]).all():
                return item, doc, score
            at = plan.first[item][:, None] + rank[:, None] + np.arange(STEP_TERMS)
            valid = at < plan.first[item + 1][:, None]
            at = np.where(valid, at, 0)
            key = doc[:, None] * plan.vocabulary + plan.term[at]
            place = np.minimum(np.searchsorted(self.keys, key), last)
            score = score + np.where(valid & (self.keys[place] == key), plan.weight[at] * self.impact[place], 0).sum(axis=1)
            rank = np.minimum(rank + STEP_TERMS, plan.terms()[item])


def _leaders(item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each item."""
    order = np.lexsort((-score, item))
    own = item[order]
    begin = np.searchsorted(own, own)
    return order[np.arange(len(own)) - begin < k]


def _best(pool: pa.Table, k: int) -> pa.Table:
    pool = pool.take(pc.sort_indices(pool, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc", "ascending")]))
    item = pool.column("item").to_numpy()
    return pool.take(pa.array(np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) < k)))


def _pass(rows: DataFrame, plan: Plan, made: np.ndarray, least: np.ndarray, k: int, only_leaders: bool) -> DataFrame:
    """Rows (item, score, doc): each task's k best. With ``only_leaders``, of the documents that lead by the terms that
    make accumulators, else of all."""
    kind = rows.schema["doc"].dataType.simpleString()

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluation = Evaluation(plan, made, least)
        pool: list[pa.Table] = []
        held = 0
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + STEP_POSTINGS, side="right")))
                part = batch.slice(start, stop - start)
                start = stop
                sizes = pc.list_value_length(part.column(2)).to_numpy()
                term, counts = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                if not len(term):
                    continue
                evaluation.load(part.column(1).to_numpy(), sizes, term, counts)
                item, doc, score = evaluation.accumulators()
                if only_leaders:
                    lead = _leaders(item, score, k)
                    item, doc, score = item[lead], doc[lead], score[lead]
                item, doc, score = evaluation.update(item, doc, score)
                found = pa.table({"item": pa.array(item), "score": pa.array(score), "doc": part.column(0).take(pa.array(doc))})
                pool.append(found)
                held += len(item)
                if held > _POOL:
                    pool = [_best(pa.concat_tables(pool), k)]
                    held = len(pool[0])
        if held:
            yield from _best(pa.concat_tables(pool), k).to_batches()

    return rows.mapInArrow(evaluate, f"item long, score long, doc {kind}")


def _block(docs: DataFrame, items: list[tuple[int, list[bytes]]], id_column: str, text_column: str, k: int) -> DataFrame:
    """Stored rows (item, rank, doc, score) of the k best documents of each of the items (number, distinct terms)."""
    numbers: dict[bytes, int] = {}
    lists = [[numbers.setdefault(t, len(numbers)) for t in own] for _, own in items]
    rows = stored(postings(docs, Vocabulary(list(numbers)), id_column, text_column), "postings")
    plan = _plan(rows, lists, len(numbers))
    least = np.zeros(len(items), np.int64)
    made = np.minimum(FIRST_TERMS, plan.terms())
    stops = plan.stops(least)
    open_ = made < stops
    order = (F.desc("score"), F.asc_nulls_last("doc"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    while open_.any():
        leaders = _pass(rows, plan, np.where(open_, made, 0), np.zeros_like(least), k, only_leaders=True)
        for r in leaders.withColumn("rank", rank).where(F.col("rank") == k).select("item", "score").collect():
            least[r.item] = max(least[r.item], r.score)
        stops = plan.stops(least)
        open_ = made < stops
        made = np.where(open_, np.minimum(2 * made, stops), stops)
        # With all that it needs made in the next round, an item's final evaluation is that round.
        open_ &= made < stops
    best = _pass(rows, plan, stops, least, k, only_leaders=False).withColumn("rank", rank).where(F.col("rank") <= k)
    given = docs.sparkSession.createDataFrame(list(enumerate(n for n, _ in items)), "item long, number long")
    return stored(best.join(F.broadcast(given), "item").select("number", "rank", "doc", "score"), "ranked")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [sorted(set(terms_of(x))) for x in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema[item_column].dataType.simpleString()
    asked = items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text"))
    asked = asked.mapInArrow(listed, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)
    asked = stored(asked.withColumn("number", F.monotonically_increasing_id()), "items")
    block: list[tuple[int, list[bytes]]] = []
    found, held = [], 0
    for r in asked.select("number", "terms").toLocalIterator():
        if block and held + len(r.terms) > block_terms:
            found.append(_block(docs, block, id_column, text_column, k))
            block, held = [], 0
        block.append((r.number, [bytes(t) for t in r.terms]))
        held += len(r.terms)
    found.append(_block(docs if block else docs.limit(0), block, id_column, text_column, k))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    named = every.join(sized(asked.select("number", "item_id")), "number")
    return named.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
