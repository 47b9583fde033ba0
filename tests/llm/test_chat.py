import hashlib
import random

from ledgerleaf.llm import chat


def expected(turns):
    text = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), text, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_come_back(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [
        (-1, 0, "user", None), (-1, 1, "assistant", ""), (-1, 2, "tool <|text|> x", "é\U0001f600</s>"), (-2, 5, "assistant", "x" * 50_000 + "</s>"),
        (-2, 3, "system", "<<SYS>>\\"), (-3, 0, None, "nobody"), (-4, 0, "user", "twice"), (-4, 0, "user", "twice"), (None, 0, "user", "no id"),
    ]
    turns = given.unionByName(spark.createDataFrame(odd, given.schema))
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.fold(chat.turn_events(turns))).collect()}
    by_conversation = {}
    for r in sorted(turns.collect(), key=lambda r: (str(r.conv_id), r.turn)):
        by_conversation.setdefault(r.conv_id, []).append((r.role or "unknown", r.text or ""))
    assert found == {k: expected(v) for k, v in by_conversation.items()}


def test_long_conversation_is_streamed(spark):
    turns = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    row = chat.read_back(chat.fold(chat.turn_events(turns))).collect()
    assert [(r.n_turns, r.turns_sha256) for r in row] == [expected([("assistant" if i % 2 else "user", f"turn {i}") for i in range(5000)])[:2]]


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "open", "user", "Hel"), (1, 1, 0, "delta", None, "lo"), (1, 2, 1, "open", "assistant", ""), (1, 3, 1, "delta", None, "wrong"),
        (1, 4, 1, "regenerate", None, ""), (1, 5, 1, "delta", None, "bet"), (1, 6, 1, "delta", None, "ter"), (1, 7, 2, "open", "user", "drop me"),
        (1, 8, 2, "delete", None, None), (1, 9, 3, "open", "user", "a"), (1, 10, 3, "edit", None, "edited"), (1, 11, 3, "delta", None, "!"), (2, 0, 9, "delta", "user", "no open"),
    ]
    log = spark.createDataFrame(events, "conversation long, seq long, message long, kind string, role string, text string")
    found = {}
    for r in sorted(chat.fold(log.repartition(5)).collect(), key=lambda r: (r.conversation, r.turn)):
        found.setdefault(r.conversation, []).append(chat.parse(r.segment))
        assert chat.unescape(r.segment[r.loss_start : r.loss_end]) == (chat.parse(r.segment)[1] if chat.parse(r.segment)[0] == "assistant" else "")
    assert found == {1: [("user", "Hello"), ("assistant", "better"), ("user", "edited!")], 2: [("user", "no open")]}


def test_escape_is_reversible_and_breaks_all_marks():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice([*chat.CONTROL, "\\", "a", "/", "s>", "<", "[", "|"]) for _ in range(8))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(mark in chat.escape(text) for mark in chat.CONTROL)
        for role in ("user", "assistant", "system", text):
            assert chat.parse(chat.render(role, text)[0]) == (role, text)


def test_empty_log(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.fold(chat.turn_events(turns))).count() == 0


LOG = "conversation long, seq long, message long, kind string, role string, text string"


def test_late_edits_and_deletes_and_alternating_streams(spark):
    events = [
        (1, 0, 5, "open", "user", "first"), (1, 1, 4, "open", "assistant", "se"), (1, 2, 3, "open", "user", "go"), (1, 3, 4, "delta", None, "cond"),
        (1, 4, 5, "edit", None, "first, edited"), (1, 5, 3, "delete", None, None), (1, 6, 2, "open", "assistant", "la"), (1, 7, 4, "regenerate", "tool", ""),
        (1, 8, 2, "delta", None, "st"), (1, 9, 4, "delta", None, "anew"), (1, 10, 3, "delta", "user", "back"), (2, 0, 5, "open", "user", "other"), (2, 1, 6, "delete", None, None),
    ]
    found = {}
    for r in sorted(chat.fold(spark.createDataFrame(events, LOG).repartition(4)).collect(), key=lambda r: (r.conversation, r.turn)):
        found.setdefault(r.conversation, []).append((r.turn, *chat.parse(r.segment)))
    assert found == {
        1: [(0, "user", "first, edited"), (1, "tool", "anew"), (2, "assistant", "last"), (3, "user", "back")],
        2: [(0, "user", "other")],
    }


def test_events_of_a_long_conversation_are_spread_over_tasks(spark):
    log = spark.range(6000).selectExpr("1L AS conversation", "id AS seq", "id % 3000 AS message", "if(id < 3000, 'open', 'delta') AS kind", "'assistant' AS role", "concat(id, ';') AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert chat.messages(log).selectExpr("spark_partition_id() AS p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    row = chat.read_back(chat.fold(log)).collect()
    assert [r[1:5] for r in row] == [expected([("assistant", f"{i};{i + 3000};") for i in range(3000)])]
