"""Sessions from other sources: messages with parts, threads of items, learning event lines, recordsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .transcripts import _get, _json, _string, _text, timestamp

#: What tool items of a thread are called.
TOOL_ITEMS = ("commandExecution", "fileChange", "mcpToolCall", "dynamicToolCall", "collabAgentToolCall", "webSearch", "imageView")
#: Domains of a learning event, and the longest id.
TRIGGERS, OUTCOMES = ("manual", "auto"), ("new", "occurrence", "lint", "rejected")
EVENT_STATUS, LONGEST_ID = ("accepted", "edited", "rejected", "existing"), 200
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def up_to_date(stored: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """Rows that are newer than what is stored of their key, or not stored."""
    old = stored.groupBy(key).agg(F.max(at).alias("_at"))
    return rows.join(old, key, "left").where(F.col("_at").isNull() | (F.col("_at") < F.col(at))).drop("_at")


def families(sessions: DataFrame) -> DataFrame:
    """(id, root, track_id) of sessions (id, parent_id): helpers belong to the session at the top."""
    from ..operators.runs import ancestry

    up = ancestry(sessions, "id", "parent_id")
    top = up.groupBy("id").agg(F.max_by("ancestor", "depth").alias("root"))
    out = sessions.select("id").join(top, "id", "left")
    main = F.col("root").isNull()
    return out.select(
        "id", F.coalesce("root", "id").alias("root"), F.when(main, "main").otherwise(F.concat(F.lit("agent:"), "id")).alias("track_id")
    )


def part_messages(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(message_id, session_id, sub_index, msg_type, sub_type, role, content_type, text, call_id, tool_name,
    input, output, status, write_path, tokens, ts) of messages (id, session_id, time_created, data) and their
    parts (id, message_id, time_created, data), data as JSON text.

    Part i of an assistant's message is at place 2i and the result of a finished tool at 2i + 1, so a tool
    that finishes later moves nothing.  Tokens go to the first text.  Parts go by time, then id.  Rows whose
    data cannot be read are left out.
    """
    m = messages.select("session_id", F.col("id").alias("message_id"), F.try_parse_json("data").alias("m")).where("m is not null")
    place = F.row_number().over(Window.partitionBy("message_id").orderBy("time_created", "id")) - 1
    p = parts.select("message_id", F.col("id").alias("part_id"), "time_created", F.try_parse_json("data").alias("p"), place.alias("i")).where("p is not null")
    role = _text(F.col("m"), "$.role")
    both = m.where(role.isin("user", "assistant")).withColumn("role", role).join(p, "message_id")
    v = F.col("p")
    kind = _text(v, "$.type")
    both = both.withColumns({"kind": kind, "ts": F.timestamp_millis("time_created")})
    first_text = both.where("kind = 'text'").groupBy("message_id").agg(F.min("i").alias("_first"))
    both = both.join(first_text, "message_id", "left")
    user = both.where("role = 'user' and i = _first")
    none = F.lit(None).cast("string")
    used = F.when(F.col("i") == F.col("_first"), _usage(F.col("m")))

    def shaped(df, sub_index, msg_type, tokens=None, **more):
        names = ("sub_type", "role", "content_type", "text", "call_id", "tool_name", "input", "output", "status", "write_path")
        empty = F.lit(None).cast("struct<input:bigint,output:bigint,cached:bigint,thinking:bigint>")
        return df.select(
            "message_id", "session_id", sub_index.cast("int").alias("sub_index"), msg_type.alias("msg_type"),
            *[more.get(n, none).alias(n) for n in names], (empty if tokens is None else tokens).alias("tokens"), "ts",
        )

    said = shaped(user, F.lit(0), F.lit("message"), role=F.lit("user"), content_type=F.lit("text"), text=F.coalesce(_string(v, "$.text"), F.lit("")))
    own = both.where("role = 'assistant'")
    k = F.col("kind")
    msg_type = (
        F.when(k.isin("text", "reasoning"), "message").when(k == "tool", "toolCall").when(k.isin("file", "patch"), "fileEvent")
        .when(k == "step-finish", "turnEvent").otherwise("custom")
    )
    aborted = _text(v, "$.reason").isin("error", "aborted")
    call_id, tool = F.coalesce(_text(v, "$.callID"), "part_id"), F.coalesce(_text(v, "$.tool"), F.lit("unknown"))
    state = _text(v, "$.state.status")
    path = F.coalesce(_text(v, "$.path"), F.when(k == "file", _text(v, "$.filename")), F.lit("unknown"))
    spoken = k.isin("text", "reasoning")
    first = shaped(
        own, F.col("i") * 2, msg_type, F.when(k == "text", used),
        sub_type=F.when(msg_type == "custom", F.coalesce(k, F.lit("unknown"))).when(k == "file", "attached").when(k == "patch", "edited"),
        role=F.when(spoken, "assistant"), content_type=F.when(k == "text", "text").when(k == "reasoning", "reasoning"),
        text=F.when(k == "text", F.coalesce(_string(v, "$.text"), F.lit(""))).when(k == "reasoning", _string(v, "$.text")),
        call_id=F.when(k == "tool", call_id), tool_name=F.when(k == "tool", tool), input=F.when(k == "tool", F.coalesce(_json(v, "$.state.input"), F.lit("{}"))),
        status=F.when(k == "step-finish", F.when(aborted, "aborted").otherwise("completed")), write_path=F.when(msg_type == "fileEvent", path),
    )
    finished = own.where((k == "tool") & state.isin("completed", "error"))
    result = shaped(
        finished, F.col("i") * 2 + 1, F.lit("toolResult"), call_id=call_id, output=_json(v, "$.state.output"),
        status=F.when(state == "completed", "success").otherwise("failure"),
        write_path=F.when((state == "completed") & tool.isin("write", "edit", "patch"), _text(v, "$.state.input.filePath")),
    )
    return said.unionByName(first).unionByName(result)


def _usage(m: Column) -> Column:
    one = lambda path: F.coalesce(F.greatest(_get(m, path, "long"), F.lit(0)), F.lit(0))
    there = F.schema_of_variant(F.try_variant_get(m, "$.tokens", "variant")).startswith("OBJECT")
    return F.when(there, F.struct(
        one("$.tokens.input").alias("input"), one("$.tokens.output").alias("output"),
        one("$.tokens.cache.read").alias("cached"), one("$.tokens.reasoning").alias("thinking"),
    ))


def latest_pages(pages: DataFrame, key: list[str], arrived: str) -> DataFrame:
    """One row a key from pages that overlap: what arrived last."""
    rest = [c for c in pages.columns if c not in key]
    return pages.groupBy(*key).agg(F.max_by(F.struct(*rest), arrived).alias("_r")).select(*key, "_r.*")


def ordered_items(turns: DataFrame, items: DataFrame) -> DataFrame:
    """Items (thread_id, turn_id, item_pos, item) of turns (thread_id, turn_id, turn_pos, status,
    completed_at) in order, ``pos`` from 0: by turn, after each turn one that says how it ended, items of
    unknown turns last."""
    ends = turns.select(
        "thread_id", "turn_id", F.lit(None).cast("int").alias("item_pos"),
        F.to_json(F.struct(F.lit("turnCompleted").alias("type"), "status", F.col("completed_at").alias("completedAt")), {"ignoreNullFields": "false"}).alias("item"),
    )
    every = items.select("thread_id", "turn_id", "item_pos", "item").unionByName(ends)
    placed = every.join(turns.select("thread_id", "turn_id", "turn_pos"), ["thread_id", "turn_id"], "left")
    order = [F.col("turn_pos").asc_nulls_last(), "turn_id", F.col("item_pos").asc_nulls_last()]
    return placed.withColumn("pos", F.row_number().over(Window.partitionBy("thread_id").orderBy(*order)) - 1).drop("turn_pos", "item_pos")


def item_messages(items: DataFrame) -> DataFrame:
    """(thread_id, pos, sub_index, msg_type, sub_type, role, text, call_id, tool_name, status, command,
    write_path) of ordered items; a tool item is a call and, at place 1, its result."""
    rows = items.withColumn("v", F.parse_json("item"))
    v = F.col("v")
    kind = _text(v, "$.type")
    rows = rows.withColumn("kind", kind)
    k, none = F.col("kind"), F.lit(None).cast("string")
    base = ("thread_id", "pos")

    def shaped(df, sub_index, msg_type, **more):
        names = ("sub_type", "role", "text", "call_id", "tool_name", "status", "command", "write_path")
        return df.select(*base, sub_index.cast("int").alias("sub_index"), msg_type.alias("msg_type"), *[more.get(n, none).alias(n) for n in names])

    b = F.col("b")
    listed = rows.where(k.isin("userMessage", "hookPrompt")).select(
        *base, "kind", F.posexplode(F.coalesce(F.try_variant_get(v, "$.content", "array<variant>"), F.try_variant_get(v, "$.fragments", "array<variant>"))).alias("sub", "b")
    )
    hook = F.col("kind") == "hookPrompt"
    fine = hook | ((_text(b, "$.type") == "text") & _string(b, "$.text").isNotNull()) | ((_text(b, "$.type") == "image") & _text(b, "$.url").isNotNull())
    fine = F.coalesce(fine, F.lit(False))
    said = shaped(
        listed, F.col("sub"), F.when(fine, "message").otherwise("custom"), role=F.when(fine, "user"),
        sub_type=F.when(hook, "toolInjection").when(~fine, F.col("kind")), text=F.when(fine, F.coalesce(_string(b, "$.text"), _text(b, "$.url"), F.lit(""))),
    )
    tool = k.isin(*TOOL_ITEMS)
    open_turn = (k == "turnCompleted") & (_text(v, "$.status") == "interrupted") & _get(v, "$.completedAt").isNull()
    spoken = k.isin("agentMessage", "plan", "reasoning")
    msg_type = (
        F.when(spoken, "message").when(k == "contextCompaction", "compaction").when((k == "turnCompleted") & ~F.coalesce(open_turn, F.lit(False)), "turnEvent")
        .when(tool, "toolCall").otherwise("custom")
    )
    thought = F.array_join(F.concat(*[F.coalesce(F.try_variant_get(v, f"$.{c}", "array<string>"), F.array().cast("array<string>")) for c in ("summary", "content")]), "\n\n")
    call_id = F.concat(F.lit("thread:"), F.sha2(F.concat_ws("|", "thread_id", "turn_id", _text(v, "$.id")), 256))
    name = F.when(k == "mcpToolCall", F.concat_ws("__", F.lit("mcp"), F.coalesce(_text(v, "$.server"), F.lit("unknown")), F.coalesce(_text(v, "$.tool"), F.lit("unknown")))).otherwise(F.coalesce(_text(v, "$.tool"), k))
    single = rows.where(~k.isin("userMessage", "hookPrompt"))
    status = _text(v, "$.status")
    one = shaped(
        single, F.lit(0), msg_type, role=F.when(spoken, "assistant"), sub_type=F.when(msg_type == "custom", k),
        text=F.when(k == "reasoning", thought).when(spoken, F.coalesce(_string(v, "$.text"), F.lit(""))),
        call_id=F.when(tool, call_id), tool_name=F.when(tool, name), command=F.when(k == "commandExecution", _text(v, "$.command")),
        status=F.when(msg_type == "turnEvent", F.when(status == "completed", "completed").otherwise("aborted")),
    )
    failed = (status == "failed") | ~_get(v, "$.success", "boolean") | (_get(v, "$.exitCode", "int") != 0)
    worked = (status == "completed") | _get(v, "$.success", "boolean")
    result = shaped(
        single.where(tool), F.lit(1), F.lit("toolResult"), call_id=call_id,
        text=F.when(k == "commandExecution", F.coalesce(_string(v, "$.aggregatedOutput"), F.lit(""))).otherwise(_json(v, "$.result")),
        status=F.when(F.coalesce(failed, F.lit(False)), "failure").when(status.isin("declined", "interrupted"), "cancelled").when(F.coalesce(worked, F.lit(False)), "success").otherwise("unknown"),
        write_path=F.when((k == "fileChange") & (status == "completed"), _text(v, "$.changes[0].path")),
    )
    return said.unionByName(one).unionByName(result)


def event_lines(lines: DataFrame) -> DataFrame:
    """(path, line, kind, reason, event): lines of learning events judged.

    ``event`` is good and has its fields by snake_case name; ``broken`` is not JSON or has an id that can
    never be stored and is passed over; ``unknown`` may be of a newer writer and holds its file: no line after
    the first unknown one of a file is an event (kind ``held``).
    """
    v = F.try_parse_json("text")
    names = (
        "event_id", "session_id", "timestamp", "cwd", "skill_version", "trigger", "why_triggered", "evidence_from_message",
        "evidence_to_message", "proposed_learning", "option_user_picked", "outcome", "status", "final_learning", "rejection_reason",
        "learning_file", "replaces",
    )

    def either(name: str) -> Column:
        first, *rest = name.split("_")
        camel = first + "".join(w.capitalize() for w in rest)
        return F.coalesce(_string(F.col("v"), f"$.{camel}"), _string(F.col("v"), f"$.{name}"))

    rows = lines.where(F.trim("text") != "").withColumn("v", v)
    required = {"why_triggered", "proposed_learning"}
    rows = rows.withColumns({n: either(n) if n in required else F.nullif(either(n), F.lit("")) for n in names})
    e = lambda n: F.col(n)
    bad_id = e("event_id").isNull() | (F.length("event_id") > LONGEST_ID)
    wrong = (
        F.when(e("session_id").isNull(), "session_id").when(timestamp(e("timestamp")).isNull(), "timestamp")
        .when(~F.coalesce(e("trigger").isin(*TRIGGERS), F.lit(False)), "trigger").when(e("why_triggered").isNull(), "why_triggered")
        .when(e("proposed_learning").isNull(), "proposed_learning").when(~F.coalesce(e("outcome").isin(*OUTCOMES), F.lit(False)), "outcome")
        .when(~e("status").isin(*EVENT_STATUS), "status").when(~e("evidence_from_message").rlike(_UUID), "evidence_from_message")
        .when(~e("evidence_to_message").rlike(_UUID), "evidence_to_message")
    )
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    reason = F.when(F.col("v").isNull(), "not JSON").when(is_object & bad_id, "event_id").when(~is_object, "not an object").otherwise(wrong)
    kind = F.when(F.col("v").isNull() | (is_object & bad_id), "broken").when(reason.isNotNull(), "unknown").otherwise("event")
    rows = rows.withColumns({"reason": reason, "kind": kind})
    first = F.min(F.when(F.col("kind") == "unknown", F.col("line"))).over(Window.partitionBy("path"))
    held = (F.col("kind") == "event") & (F.col("line") > first)
    return rows.withColumn("kind", F.when(F.coalesce(held, F.lit(False)), "held").otherwise(F.col("kind"))).select(
        "path", "line", "kind", "reason", F.when(F.col("kind") == "event", F.struct(*names)).alias("event")
    )


def recordset(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON array of objects as rows with the columns of ``schema``; what is no array gives none."""
    return df.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))




def reconciled(old: DataFrame, new: DataFrame, by: list[str], place: str, item: str) -> DataFrame:
    """(by, place, item, fate) of two readings of ordered lists: what is ``kept``, ``withdrawn`` or ``fresh``.

    A list is the same up to the first place where the readings differ; what the old one has from there on was rolled
    back, whatever it is, and what the new one has there is fresh.  Places count from 1 without holes.  Each
    reading carries, at every place, a mark of all its items up to there, so that two places meet only if
    nothing before them differs: one join on (list, place, mark), however long the lists are.
    """
    w = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)

    def marked(rows: DataFrame) -> DataFrame:
        one = [F.xxhash64(F.lit(seed), F.col(place).cast("long"), F.col(item)) for seed in (1, 2)]  # 128 bits together
        return rows.select(*by, place, item, F.bit_xor(one[0]).over(w).alias("_m1"), F.bit_xor(one[1]).over(w).alias("_m2"))

    a, b = marked(old), marked(new).withColumn("_b", F.lit(True))
    key = [*by, place, "_m1", "_m2"]
    met = a.join(b.drop(item), key, "left").withColumn("fate", F.when(F.col("_b").isNotNull(), "kept").otherwise("withdrawn"))
    fresh = b.join(a.select(*key), key, "left_anti").withColumn("fate", F.lit("fresh"))
    return met.select(*by, place, item, "fate").unionByName(fresh.select(*by, place, item, "fate"))


def still_pending(pending: DataFrame, turns: DataFrame, read: DataFrame, finished: DataFrame) -> DataFrame:
    """Items (thread_id, turn_id, item_id, ...) that still wait: not finished, and their turn is still there.

    A thread that was not ``read`` this time (thread_id) has no turns to check, so its items stay.
    """
    left = pending.join(finished.select("thread_id", "turn_id", "item_id"), ["thread_id", "turn_id", "item_id"], "left_anti")
    seen = read.select("thread_id", F.lit(True).alias("_read")).distinct()
    there = turns.select("thread_id", "turn_id", F.lit(True).alias("_turn")).distinct()
    met = left.join(seen, "thread_id", "left").join(there, ["thread_id", "turn_id"], "left")
    return met.where("_read is null or _turn is not null").select(*pending.columns)
