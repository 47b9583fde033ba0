"""Document classification as columns: folder, filename and content signals, then a weighted vote.

Nothing here shuffles. Scores are sums of doubles in a fixed order, so equal inputs always give
equal scores and ties fall to the earlier type.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.constants import (
    CONTENT_KEYWORD_SCORE,
    EXTENSION_SCORE,
    FILENAME_KEYWORD_SCORE,
    FOLDER_CONFIDENCE,
    FOLDER_MIN_CONFIDENCE,
    MODEL_TYPE_CONFIDENCE,
    MODEL_TYPE_REPLIES,
    OTHER_TYPE,
    PATH_KEYWORD_SCORE,
    TYPE_KEYWORDS,
    VOTE_WEIGHTS,
)
from ledgerleaf.functions.text import as_col, file_suffix, let, strip, text_array
from ledgerleaf.operators.generate import generate

Keywords = Mapping[str, Mapping[str, Sequence[str]]]


def _signal(label: Column, confidence: Column) -> Column:
    return F.struct(label.alias("type"), confidence.alias("confidence"))


def _first_best(scores: Mapping[str, Column]) -> Column:
    """(type, confidence) of the highest score; the earlier type wins a tie, no score at all is 'other'."""
    names = list(scores)

    def pick(values: Column) -> Column:
        best = F.array_max(values)
        label = F.element_at(text_array(names), F.array_position(values, best).cast("int"))
        return F.when(best > 0, _signal(label, best)).otherwise(_signal(F.lit(OTHER_TYPE), F.lit(0.0)))

    return let(F.array(*scores.values()), pick)


def folder_signal(path: Column | str, keywords: Keywords = TYPE_KEYWORDS) -> Column:
    """First type whose name (also with an 's', or with blanks for '_') is part of the path."""
    lowered = F.lower(as_col(path))
    label = F.lit(None).cast("string")
    for doc_type in reversed(list(keywords)):
        names = (doc_type, doc_type + "s", doc_type.replace("_", " "))
        found = lowered.contains(names[0]) | lowered.contains(names[1]) | lowered.contains(names[2])
        label = F.when(found, doc_type).otherwise(label)
    return F.struct(
        F.coalesce(label, F.lit(OTHER_TYPE)).alias("type"),
        F.when(label.isNotNull(), FOLDER_CONFIDENCE).otherwise(0.0).alias("confidence"),
    )


def filename_signal(filename: Column | str, path: Column | str, keywords: Keywords = TYPE_KEYWORDS) -> Column:
    """Keyword hits in name and path plus an extension hint, capped at 1."""
    name = F.lower(as_col(filename))
    where = F.lower(F.coalesce(as_col(path), F.lit("")))
    extension = file_suffix(filename)

    def score(spec: Mapping[str, Sequence[str]]) -> Column:
        hits = F.aggregate(
            text_array(spec["keywords"]),
            F.lit(0.0),
            lambda total, word: total
            + F.when(F.contains(name, word), FILENAME_KEYWORD_SCORE).otherwise(0.0)
            + F.when(F.contains(where, word), PATH_KEYWORD_SCORE).otherwise(0.0),
        )
        hint = F.when(extension.isin(*spec["extensions"]), EXTENSION_SCORE).otherwise(0.0)
        return F.least(hits + hint, F.lit(1.0))

    return _first_best({doc_type: score(spec) for doc_type, spec in keywords.items()})


def content_signal(lowered_text: Column | str, keywords: Keywords = TYPE_KEYWORDS) -> Column:
    """Distinct keywords present in an already lower-cased text, capped at 1."""
    text = as_col(lowered_text)

    def score(spec: Mapping[str, Sequence[str]]) -> Column:
        present = F.size(F.filter(text_array(spec["keywords"]), lambda word: F.contains(text, word)))
        return F.least(present * CONTENT_KEYWORD_SCORE, F.lit(1.0))

    return _first_best({doc_type: score(spec) for doc_type, spec in keywords.items()})


def vote(folder: Column, filename: Column, content: Column | None = None) -> Column:
    """Weighted vote of the signals; a tie goes to folder before filename before content."""

    def ballot(signal: Column, name: str) -> Column:
        return F.struct(
            signal["type"].alias("type"), (signal["confidence"] * VOTE_WEIGHTS[name]).alias("value")
        )

    cast = [
        F.when(folder["confidence"] > FOLDER_MIN_CONFIDENCE, ballot(folder, "folder")),
        ballot(filename, "filename"),
    ]
    if content is not None:
        cast.append(F.when(content.isNotNull(), ballot(content, "content")))

    def count(ballots: Column) -> Column:
        totals = F.transform(
            ballots,
            lambda one: F.aggregate(
                ballots,
                F.lit(0.0),
                lambda total, other: total + F.when(other["type"] == one["type"], other["value"]).otherwise(0.0),
            ),
        )

        def pick(values: Column) -> Column:
            best = F.array_max(values)
            winner = F.element_at(ballots, F.array_position(values, best).cast("int"))
            return _signal(winner["type"], F.least(best, F.lit(1.0)))

        return let(totals, pick)

    return let(F.array_compact(F.array(*cast)), count)


def classify(
    documents: DataFrame,
    filename: str = "filename",
    path: str = "relative_path",
    content: str | None = None,
    keywords: Keywords = TYPE_KEYWORDS,
    content_ballot: str | None = None,
) -> DataFrame:
    """Add ``document_type`` and ``classification_confidence``.

    ``content`` names a text column to score by keywords; ``content_ballot`` names a ready
    (type, confidence) struct instead, e.g. from ``classify_by_model``.
    """
    base = documents.withColumn("_folder", folder_signal(path, keywords)).withColumn(
        "_filename", filename_signal(filename, path, keywords)
    )
    ballot = None
    if content_ballot is not None:
        ballot = F.col(content_ballot)
    elif content is not None:
        base = base.withColumn("_lowered", F.lower(F.col(content))).withColumn(
            "_content", content_signal("_lowered", keywords)
        )
        # A document without content casts no content ballot.
        ballot = F.when(F.length(content) > 0, F.col("_content"))
    voted = base.withColumn("_vote", vote(F.col("_folder"), F.col("_filename"), ballot))
    return voted.withColumns(
        {
            # Never NULL, which saves joins on the type from testing for it.
            "document_type": F.coalesce("_vote.type", F.lit(OTHER_TYPE)),
            "classification_confidence": F.col("_vote.confidence"),
        }
    ).drop("_folder", "_filename", "_lowered", "_content", "_vote")


def classify_by_model(
    documents: DataFrame,
    fn: Callable[[list[str]], list[str]],
    filename: str = "filename",
    text: str = "text",
    keywords: Keywords = TYPE_KEYWORDS,
    preview_chars: int | None = None,
) -> DataFrame:
    """Add ``model_ballot`` (type, confidence) from a text generator; its errors fall back to keywords.

    The whole text goes into the prompt, or its first ``preview_chars`` characters if a caller wants only these.
    Documents are asked about where they are read, so that no text is shuffled; store the result if it is read twice.
    """
    preview = F.col(text) if preview_chars is None else F.substring(F.col(text), 1, preview_chars)
    prompt = F.concat(
        F.lit("Name the category of this document: financial, pitch_deck, technical, legal, product or other.\n"),
        F.lit("Filename: "),
        F.col(filename),
        F.lit("\n\nContent preview:\n"),
        preview,
        F.lit("\n\nCategory:"),
    )
    replied = generate(documents.withColumn("_prompt", prompt), "_prompt", fn, "_reply", "_error", distinct=False)
    reply = F.replace(F.lower(strip("_reply")), F.lit("_"), F.lit(" "))
    names = F.create_map(*[F.lit(part) for pair in MODEL_TYPE_REPLIES.items() for part in pair])
    by_model = F.struct(
        F.coalesce(F.try_element_at(names, reply), F.lit(OTHER_TYPE)).alias("type"),
        F.lit(MODEL_TYPE_CONFIDENCE).alias("confidence"),
    )
    return (
        replied.withColumn("_lowered", F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(
            "model_ballot", F.when(F.col("_error").isNull(), by_model).otherwise(content_signal("_lowered", keywords))
        )
        .drop("_prompt", "_reply", "_error", "_lowered")
    )
