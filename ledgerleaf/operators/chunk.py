"""Overlapping chunks that prefer to end at a sentence.

Where each chunk starts depends on where the one before ended, so the bounds of a document are one
native fold over its sentence ends, in blocks of sentences, so that the list of bounds found so far is
copied once per block only. Chunk texts are cut from fixed-length blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import ids
from ledgerleaf.functions.constants import CHUNK_BREAK_WINDOW, CHUNK_OVERLAP, CHUNK_SIZE
from ledgerleaf.functions.text import as_col, strip

# A sentence end is one of these followed by a blank or a line break.
_SENTENCE_END = r"[.!?](?=[ \n])"
_BLOCK = 16384
# Sentences folded at a time.
_FOLDED = 512


def sentence_lengths(text: Column | str) -> Column:
    """Lengths of the pieces between sentence ends, each but the last with its closing punctuation."""
    return F.transform(F.split(as_col(text), _SENTENCE_END), lambda piece: F.length(piece) + 1)


def chunk_ends(
    lengths: Column | str,
    length: Column | str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    window: int = CHUNK_BREAK_WINDOW,
) -> Column:
    """End offsets (in characters) of the chunks of a text of at least ``size`` characters.

    ``lengths`` are its ``sentence_lengths``, ``length`` is its length; both should be plain columns, as
    the fold reads them at every step. The first chunk starts at 0, each later one ``overlap`` before the
    previous end. A chunk ends at the first sentence end less than ``window`` away from ``size``
    characters, else after ``size``.
    """
    if overlap >= size - window:
        raise ValueError("overlap must be smaller than size - window, or chunks would stop moving forward")
    step = size - overlap
    near, far = size - window, size + window
    total = as_col(length)
    none = F.array().cast("array<int>")

    def state_of(at: Column, start: Column, ends: Column) -> Column:
        return F.struct(
            at.cast("int").alias("at"), start.cast("int").alias("start"), ends.cast("array<int>").alias("ends")
        )

    def visit(state: Column, piece: Column) -> Column:
        start, ends = state["start"], state["ends"]
        cut = state["at"] + piece
        # A cut out of reach: first come the chunks of exactly ``size`` characters that end before it.
        jumps = F.ceil((cut - start - far) / step).cast("int")
        fixed = F.transform(F.sequence(F.lit(0), jumps - 1), lambda i: start + i * step + size)
        later = start + jumps * step
        reached = (cut > later + near) & (later + size < total)
        return (
            F.when(cut <= start + near, state_of(cut, start, ends))
            .when((cut <= start + far) & (start + size < total),
                  state_of(cut, cut - overlap, F.concat(ends, F.array(cut))))
            .when(cut <= start + far, state_of(cut, start, ends))
            .when(reached, state_of(cut, cut - overlap, F.concat(ends, fixed, F.array(cut))))
            .otherwise(state_of(cut, later, F.concat(ends, fixed)))
        )

    def visit_block(state: Column, block: Column) -> Column:
        # The ends of a block are listed on their own: a list that grows with the text is copied once per block.
        last = block * _FOLDED + _FOLDED
        pieces = F.slice(as_col(lengths), block * _FOLDED + 1, F.least(last, F.size(as_col(lengths)) - 1) - block * _FOLDED)
        inner = F.aggregate(pieces, state_of(state["at"], state["start"], none), visit)
        return state_of(inner["at"], inner["start"], F.concat(state["ends"], inner["ends"]))

    def close(state: Column) -> Column:
        left = F.ceil((total - state["start"]) / step).cast("int")
        tail = F.transform(F.sequence(F.lit(0), left - 1), lambda i: (state["start"] + size + i * step).cast("int"))
        return F.concat(state["ends"], tail)

    closing = F.size(as_col(lengths)) - 1
    blocks = F.when(closing > 0, F.sequence(F.lit(0), F.floor((closing - 1) / _FOLDED).cast("int"))).otherwise(none)
    return F.aggregate(blocks, state_of(F.lit(0), F.lit(0), none), visit_block, close)


def _cut(blocks: Column, body: Column, start: Column, length: Column) -> Column:
    block = F.floor(start / _BLOCK).cast("int")
    pair = F.concat(F.get(blocks, block), F.coalesce(F.get(blocks, block + 1), F.lit("")))
    return F.when(F.size(blocks) == 0, F.substring(body, start + 1, length)).otherwise(
        F.substring(pair, start - block * _BLOCK + 1, length)
    )


def chunk(
    documents: DataFrame,
    text: str = "text",
    document_id: str = "document_id",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    window: int = CHUNK_BREAK_WINDOW,
    max_chunks: int | None = None,
    drop_contained_tail: bool = False,
    places: Mapping[str, Callable[[Column], Column]] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """One row per chunk: the other columns of ``documents`` plus ``chunk_id, chunk_index, chunk_start, text,
    char_count``, and the columns of ``places``, which are functions of a chunk's start. Those in ``drop`` serve these
    functions and are not repeated for each chunk.

    A text shorter than ``size`` is one untrimmed chunk. Longer ones are cut by ``chunk_ends``, trimmed, and
    blank chunks are left out while the index still advances. A closing chunk may lie wholly inside its
    predecessor; ``drop_contained_tail`` removes it. ``max_chunks`` limits the chunks of a document
    (1001 reproduces the usual runaway guard); by default the whole text is chunked.
    """
    if size + window > _BLOCK:
        raise ValueError(f"size + window must not exceed {_BLOCK}")
    body, length = F.col("_body"), F.col("_length")
    is_short = F.coalesce(length < size, F.lit(True))
    kept = [name for name in documents.columns if name != text and name not in drop]
    places = dict(places or {})

    prepared = (
        documents.withColumn("_body", F.col(text))
        .withColumn("_length", F.length("_body"))
        .withColumn("_lengths", F.when(~is_short, sentence_lengths(body)))
        .withColumn("_ends", F.when(~is_short, chunk_ends("_lengths", length, size, overlap, window)))
        .withColumn(
            "_blocks",
            F.when(length > 2 * _BLOCK, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)))
            .otherwise(F.array().cast("array<string>")),
        )
    )
    ends = F.col("_ends") if max_chunks is None else F.slice("_ends", 1, max_chunks)

    def piece(end: Column, index: Column) -> Column:
        start = F.when(index == 0, F.lit(0)).otherwise(F.get(F.col("_ends"), index - 1) - overlap)
        raw = _cut(F.col("_blocks"), body, start, end - start)
        return F.struct(
            index.alias("chunk_index"),
            start.alias("chunk_start"),
            end.alias("chunk_end"),
            strip(raw).alias("text"),
            *[place(start).alias(name) for name, place in places.items()],
        )

    cut = F.transform(ends, piece)
    if drop_contained_tail:
        cut = F.filter(
            cut, lambda c: (c["chunk_index"] == 0) | (F.get(F.col("_ends"), c["chunk_index"] - 1) < length)
        )
    whole = F.array(
        F.struct(
            F.lit(0).alias("chunk_index"), F.lit(0).alias("chunk_start"), length.alias("chunk_end"),
            body.alias("text"),
            *[place(F.lit(0)).alias(name) for name, place in places.items()],
        )
    )
    pieces = F.when(is_short, whole).otherwise(F.filter(cut, lambda c: F.length(c["text"]) > 0))
    return (
        prepared.select(*kept, F.explode(pieces).alias("_chunk"))
        .select(
            ids.chunk_id(document_id, "_chunk.chunk_index").alias("chunk_id"),
            *kept,
            F.col("_chunk.chunk_index").alias("chunk_index"),
            F.col("_chunk.chunk_start").alias("chunk_start"),
            F.col("_chunk.text").alias("text"),
            F.length("_chunk.text").alias("char_count"),
            *[F.col(f"_chunk.{name}").alias(name) for name in places],
        )
    )


def as_of(starts: Column, at: Column) -> Column:
    """How many of the ascending ``starts`` are at or before ``at``, found by halving."""
    size = F.size(starts)
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        is_open = state["low"] < state["high"]
        before = F.get(starts, middle) <= at
        return F.struct(
            F.when(is_open & before, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(is_open & ~before, middle).otherwise(state["high"]).alias("high"),
        )

    return F.aggregate(
        halvings, F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda state: state["low"]
    )


def page_at(page_starts: str = "page_starts") -> Callable[[Column], Column]:
    """Page of a place: the last that begins at or before it; NULL for texts without pages."""
    starts = F.col(page_starts)
    return lambda at: F.when(F.size(starts) > 0, F.greatest(as_of(starts, at), F.lit(1)))


def title_at(headings: str = "headings") -> Callable[[Column], Column]:
    """Heading of a place: the last that begins at or before it, NULL if there is none."""
    starts, titles = F.col(f"{headings}.at"), F.col(f"{headings}.title")
    return lambda at: F.get(titles, as_of(starts, at) - 1)


def add_page_number(chunks: DataFrame, page_starts: str = "page_starts") -> DataFrame:
    """Add ``page_number``: the last page that begins at or before the chunk.

    ``page_starts`` holds the start offset of each page in page order.
    """
    return chunks.withColumn(
        "page_number",
        F.greatest(F.size(F.filter(page_starts, lambda start: start <= F.col("chunk_start"))), F.lit(1)),
    )


def heading_offsets(text: Column | str) -> Column:
    """Offsets and titles of the markdown headings of a text, in order."""
    lines = F.split(as_col(text), "\n")

    def visit(state: Column, line: Column) -> Column:
        title = F.regexp_extract(line, r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)
        found = F.struct(state["at"].alias("at"), title.alias("title"))
        return F.struct(
            (state["at"] + F.length(line) + 1).cast("int").alias("at"),
            F.when(F.length(title) > 0, F.concat(state["found"], F.array(found)))
            .otherwise(state["found"])
            .alias("found"),
        )

    begin = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<at:int,title:string>>").alias("found")
    )
    return F.aggregate(lines, begin, visit, lambda state: state["found"])


def add_section_title(chunks: DataFrame, headings: str = "headings") -> DataFrame:
    """Add ``section_title``: the last heading that begins at or before the chunk, NULL if there is none."""
    before = F.filter(headings, lambda heading: heading["at"] <= F.col("chunk_start"))
    return chunks.withColumn("section_title", F.try_element_at(before, F.lit(-1))["title"])
