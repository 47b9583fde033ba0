"""Chat formatting from event logs: messages are folded from events and rendered with a loss mask.

Events are rows (conversation, seq, message, kind, role, text). ``open`` starts a message, ``delta`` adds text at its
end, ``edit`` replaces its text, ``regenerate`` empties it (and takes a new role, if one is given) so that deltas
stream anew, ``delete`` removes it. Events are dealt by conversation and message and sorted by sequence; a task folds
and renders one message at a time, so late events reach their message wherever it stands, the events of a long
conversation are spread over tasks, and no more memory is needed than for the largest message. A final message stands
where it was opened: rendered messages are then dealt by conversation and streamed in that order. Rendered turns are
segments (conversation, turn, formatted text, spans under the loss mask): their concatenation in order is the training
text. ``read_back`` streams over segments in the same way; as its hashes run over whole conversations, this pass is one
task for each conversation, whatever its length.

The template is that of instruction models. Control strings inside texts and roles get a backslash after their first
character (and backslashes are doubled), so that none can be taken for a mark, and the change can be undone.

Events of several messages may alternate. Ties of ``seq`` inside a message go by kind, role and text; messages opened at
the same ``seq`` go by message and formatted text. Defined cases: null text is empty; a null role is the role
``unknown``; deltas, edits and regenerations without an open message (also after its delete) open one there; a second
open of a message starts another, to which later events belong; a null conversation is a conversation of its own, a null
message a message; an empty log gives no segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks around a turn by role; other roles are named in a header of their own.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
LOSS_ROLE = "assistant"
CONTROL = tuple(mark for pair in TEMPLATE.values() for mark in pair) + OTHER
_INSIDE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNDO = re.compile(r"\\(.)", re.DOTALL)

EVENTS = "message long, kind string, role string, text string"
SEGMENTS = "segment string, loss_start int, loss_end int"


def escape(text: str) -> str:
    """No control string is left in the result: each is broken by a backslash behind its first character."""
    return _INSIDE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted text, and the span of its body under the loss mask (empty for other roles)."""
    if role in TEMPLATE:
        start, end = TEMPLATE[role]
    else:
        start, end = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    body = escape(text)
    out = f"{start}{body}{end}"
    return (out, len(start), len(start) + len(body)) if role == LOSS_ROLE else (out, 0, 0)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    for role, (start, end) in TEMPLATE.items():
        if segment.startswith(start):
            return role, unescape(segment[len(start) : -len(end)])
    role, _, rest = segment[len(OTHER[0]) :].partition(OTHER[1])
    return unescape(role), unescape(rest[: -len(OTHER[2])])


def turn_events(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log for finished turns: each row opens a message and streams its text as deltas of 4,000 characters.

    Rows of equal turn go by role and digest of the text; equal rows are messages of their own.
    """
    size = 4000
    body = F.coalesce(F.col(text), F.lit(""))
    count = F.greatest(F.ceil(F.length(body) / size), F.lit(1)).cast("int")
    rows = turns.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).cast("long").alias("message"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.sha2(body, 256).alias("tie"),
        # Tells equal rows apart; which of them gets which number makes no difference.
        F.monotonically_increasing_id().alias("copy"),
        body.alias("body"),
        F.explode(F.sequence(F.lit(0), count)).alias("part"),
    )
    opening = F.col("part") == 0
    return rows.select(
        "conversation",
        F.struct("message", "role", "tie", "copy", "part").alias("seq"),
        "message",
        F.when(opening, "open").otherwise("delta").alias("kind"),
        "role",
        F.when(opening, "").otherwise(F.substring("body", (F.col("part") - 1) * size + 1, F.lit(size))).alias("text"),
    )


def messages(events: DataFrame) -> DataFrame:
    """Final messages, rendered: rows (conversation, seq of the opening, message, segment, loss_start, loss_end)."""
    types = {c: events.schema[c].dataType.simpleString() for c in ("conversation", "seq", "message")}
    log = (
        events.repartition("conversation", "message")
        .sortWithinPartitions("conversation", "message", "seq", "kind", "role", "text")
        .select("conversation", "seq", "message", "kind", "role", "text")
    )

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[object, object, object, str, int, int]] = []
        key: tuple[object, object] | None = None
        current: list[object] = []  # seq, role, parts of the text
        kinds: list[pa.DataType] = []
        size = 0

        def close() -> None:
            nonlocal current
            if current:
                seq, role, parts = current
                out.append((key[0], seq, key[1], *render(role, "".join(parts))))
                current = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            names = ["conversation", "seq", "message", "segment", "loss_start", "loss_end"]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            kinds = [*(batch.column(i).type for i in range(3)), pa.string(), pa.int32(), pa.int32()]
            for conversation, seq, message, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size += len(text or "")
                if kind == "open" or key != (conversation, message):
                    close()
                    key = (conversation, message)
                if kind == "delete":
                    current = []
                    continue
                if not current:
                    current = [seq, role or "unknown", []]
                if kind in ("delta", "open"):
                    current[2].append(text or "")
                elif kind == "edit":
                    current[2] = [text or ""]
                elif kind == "regenerate":
                    current[1:] = [role or current[1], [text or ""]]
                if size > 4_000_000 and out:
                    yield batch_of()
                    size = 0
        close()
        if out:
            yield batch_of()

    return log.mapInArrow(folded, ", ".join(f"{c} {t}" for c, t in types.items()) + f", {SEGMENTS}")


def fold(events: DataFrame) -> DataFrame:
    """Segments (conversation, turn, segment, loss_start, loss_end), rendered from the final messages of a log.

    Rows stay in the partitions and the order in which they are numbered, so that ``read_back`` needs no shuffle.
    """
    key = events.schema["conversation"].dataType.simpleString()
    placed = (
        messages(events)
        .repartition("conversation")
        .sortWithinPartitions("conversation", "seq", "message", "segment")
        .select("conversation", "segment", "loss_start", "loss_end")
    )

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, turn = object(), 0
        for batch in batches:
            turns = []
            for conversation in batch.column(0).to_pylist():
                turn = turn + 1 if conversation == last else 0
                last = conversation
                turns.append(turn)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(turns, pa.int64()), *batch.columns[1:]], ["conversation", "turn", "segment", "loss_start", "loss_end"]
            )

    return placed.mapInArrow(numbered, f"conversation {key}, turn long, {SEGMENTS}")


def read_back(segments: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per conversation, parsed from its segments: n_turns, turns_sha256 (role, line feed, text, line feed of each
    turn), loss_chars and loss_sha256 (of the unescaped text under the mask), formatted_chars. ``segments`` holds each
    conversation in one partition and in order, as ``fold`` leaves them."""
    key = segments.schema["conversation"].dataType.simpleString()
    schema = f"`{conversation}` {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[object] | None = None

        def batch_of(kind: pa.DataType, rows: list[list[object]]) -> pa.RecordBatch:
            columns = list(zip(*([k, n, t.hexdigest(), c, m.hexdigest(), f] for k, n, t, c, m, f in rows), strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            done = []
            for key, segment, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or state[0] != key:
                    if state is not None:
                        done.append(state)
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(segment)
                loss = unescape(segment[a:b])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(segment)
            if done:
                yield batch_of(kind, done)
        if state is not None:
            yield batch_of(kind, [state])

    return segments.mapInArrow(read, schema)
