"""Pluggable text generation: prompts go to a callable in Arrow batches, each distinct prompt once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.session import stored

Generator = Callable[[list[str]], list[str]]

# Rows of one prompt that meet its reply under one key.
ROWS_PER_SHARE = 100_000
# Keys of at most this many prompts are broadcast to pick the prompts that have to be asked.
MAX_SHARED_KEYS = 500_000


class Replies(Protocol):
    """Replies of earlier runs (see ``sinks.tables.StoredReplies``)."""

    def known(self) -> DataFrame:
        """Rows (prompt_key, reply)."""

    def add(self, replies: DataFrame) -> int:
        """Keep rows (prompt_key, reply)."""


def _reply(fn: Generator, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """Replies of one batch; if the batch fails, each prompt is tried alone to find the failing ones."""
    try:
        replies = list(fn(prompts))
        if len(replies) == len(prompts):
            return [(reply, None) for reply in replies]
        failure = f"{len(replies)} replies to {len(prompts)} prompts"
    except Exception as error:  # the callable is user code: any failure becomes a row's error
        failure = str(error) or type(error).__name__
    if len(prompts) == 1:
        return [(None, failure)]
    return [pair for prompt in prompts for pair in _reply(fn, [prompt])]


def _by_row(rows: DataFrame, counted: DataFrame, found: DataFrame, row_id: str) -> DataFrame:
    """Replies by row id. Prompts of many rows meet their reply under several keys; there are at most
    rows / ``ROWS_PER_SHARE`` of them."""
    parts = F.ceil(F.col("_rows") / ROWS_PER_SHARE)
    hot = counted.filter(F.col("_rows") > ROWS_PER_SHARE).select("_key", parts.alias("_parts")).collect()
    if not hot:
        return rows.join(found, "_key").drop("_key")
    listed = F.broadcast(rows.sparkSession.createDataFrame(hot, "_key string, _parts long"))
    shares = F.coalesce("_parts", F.lit(1).cast("long"))
    left = rows.join(listed, "_key", "left").select(row_id, "_key", F.pmod(F.xxhash64(row_id), shares).alias("_share"))
    right = found.join(listed, "_key", "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    return left.join(right.drop("_parts"), ["_key", "_share"]).drop("_key", "_share")


def generate(
    df: DataFrame,
    prompt: str,
    fn: Generator,
    reply: str = "reply",
    error: str = "error",
    distinct: bool = True,
    batch_size: int = 64,
    parallelism: int | None = None,
    row_id: str | None = None,
    replies: Replies | None = None,
) -> DataFrame:
    """Add ``reply`` and ``error`` columns. ``fn`` maps a list of prompts to as many replies.

    With ``distinct`` equal prompts are asked once: the group-by combines copies before its shuffle,
    so a prompt repeated in a third of all rows costs one call and one row. The replies are written to the
    shared folder at once, so that no later step and no lost executor asks again; with ``replies`` they outlive the run,
    and only prompts without a reply in them are asked (errors are not kept, and asked again). ``row_id`` names a column
    that tells the rows of ``df`` apart: then only ids, hashes and replies are moved to bring rows and replies together.
    Without ``distinct`` nothing is written; store the result yourself if it is read more than once. ``parallelism`` sets
    the number of tasks that ask: prompts are small and their answers slow, so few tasks may be too few.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                pairs = _reply(fn, part["_text"].tolist())
                yield pd.DataFrame(
                    {
                        "_key": part["_key"].to_numpy(),
                        reply: [pair[0] for pair in pairs],
                        error: [pair[1] for pair in pairs],
                    }
                )

    schema = f"_key string, `{reply}` string, `{error}` string"
    if distinct:
        given = df.filter(F.col(prompt).isNotNull()).withColumn("_key", F.sha2(F.col(prompt), 256))
        counted = stored(given.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")), "keys")
        wanted = given
        if replies is not None:
            known = replies.known().withColumnRenamed("prompt_key", "_key").join(counted.select("_key"), "_key", "left_semi")
            known = known.groupBy("_key").agg(F.max("reply").alias(reply))
            missing = stored(counted.select("_key").join(known, "_key", "left_anti"), "missing")
            few = missing.count() <= MAX_SHARED_KEYS
            wanted = given.join(F.broadcast(missing) if few else missing, "_key", "left_semi")
        prompts = wanted.groupBy("_key").agg(F.any_value(F.col(prompt)).alias("_text"))
        if parallelism is not None:
            prompts = prompts.repartition(parallelism, "_key")
        found = stored(prompts.mapInPandas(ask, schema), "replies")
        if replies is not None:
            known = stored(known.withColumn(error, F.lit(None).cast("string")), "known")
            replies.add(found.filter(F.col(error).isNull()).select(F.col("_key").alias("prompt_key"), F.col(reply).alias("reply")))
            found = found.unionByName(known)
        if row_id is None:
            none = {name: F.lit(None).cast("string") for name in (reply, error)}
            return given.join(found, "_key").drop("_key").unionByName(df.filter(F.col(prompt).isNull()).withColumns(none))
        return df.join(_by_row(given.select(row_id, "_key"), counted, found, row_id), row_id, "left")

    fields = [field for field in df.schema.fields if field.name not in (reply, error)]
    names = [field.name for field in fields]

    def ask_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size].reset_index(drop=True)
                pairs: list[tuple[str | None, str | None]] = [(None, None)] * len(part)
                given = [i for i, text in enumerate(part[prompt]) if text is not None]
                for i, pair in zip(given, _reply(fn, part[prompt].iloc[given].tolist()) if given else []):
                    pairs[i] = pair
                yield part[names].assign(
                    **{reply: [pair[0] for pair in pairs], error: [pair[1] for pair in pairs]}
                )

    rows = df.select(*names) if parallelism is None else df.select(*names).repartition(parallelism)
    return rows.mapInPandas(ask_rows, df.select(*names).schema.add(reply, "string").add(error, "string"))


def extractive_reply(prompts: list[str]) -> list[str]:
    """Offline default: the first line after the first "[Document ...]" heading, else a short notice."""
    replies = []
    for prompt in prompts:
        _, found, rest = prompt.partition("[Document 1 - ")
        lines = rest.split("]\n", 1)
        replies.append(lines[1].split("\n", 1)[0] if found and len(lines) == 2 else "No context given.")
    return replies
