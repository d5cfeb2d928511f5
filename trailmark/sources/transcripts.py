"""Transcripts on disk: files to numbered lines, lines to JSON records, records to typed messages.

Everything is column expressions over one row a file, then one row a line, then one row a message; no
file is ever larger than a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import line_id, redact

#: Tags by which a line is a local command.
COMMAND_TAGS = ("local-command-caveat", "command-name", "command-message", "local-command-stdout", "local-command-stderr")
#: Notices of the system that are plain events.
NOTICES = ("away_summary", "scheduled_task_fire")
#: Attachments and lines that are plain events.
PLAIN_ATTACHMENTS = ("date_change", "auto_mode")
PLAIN_LINES = ("summary", "file-history-snapshot", "file-history-delta")
HOOKS = ("hook_success", "hook_non_blocking_error", "hook_cancelled", "async_hook_response", "hook_progress", "hook_additional_context")
ROLES = ("user", "assistant", "system", "developer")


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, modified, size, content), a row a file."""
    meta = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "path"), ("file_modification_time", "modified"), ("file_size", "size"))]
    return spark.read.text(paths, wholetext=True).select(*meta, F.col("value").alias("content"))


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose (modified, size) differ from the checkpoint ``seen`` (path, modified, size, lines), with
    ``from_line`` to resume at: 1 for new files and such that shrank."""
    old = seen.select("path", F.col("modified").alias("_m"), F.col("size").alias("_s"), F.col("lines").alias("_n"))
    met = files.join(old, "path", "left")
    same = (F.col("modified") == F.col("_m")) & (F.col("size") == F.col("_s"))
    resume = F.when(F.col("_s").isNull() | (F.col("size") < F.col("_s")), F.lit(1)).otherwise(F.col("_n") + 1)
    return met.where(~F.coalesce(same, F.lit(False))).withColumn("from_line", resume.cast("int")).drop("_m", "_s", "_n")


def complete_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of the lines that end with a line feed, numbered from 1."""
    lines = F.split("content", "\n")
    whole = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    return files.select("path", F.posexplode(whole).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): (path, line, raw) JSON objects of good files, and (path, line) of the first bad
    line of files that hold anything but objects.  Blank lines keep their number and say nothing."""
    text = F.trim("text")
    parsed = F.try_parse_json(text)
    good = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    some = lines.where(text != "").select("path", "line", text.alias("raw"), good.alias("_good"))
    rejects = some.where("not _good").groupBy("path").agg(F.min("line").alias("line"))
    return some.where("_good").join(rejects.select("path"), "path", "left_anti").drop("_good"), rejects


def classify(path: Column) -> Column:
    """Struct (session_id, track_id, agent_id) of a transcript's path below its project's folder; null for
    journals and anything else."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.regexp_extract(clean, r"/projects/[^/]+/(.+\.jsonl)$", 1)
    main = F.regexp_extract(below, r"^([^/]+)\.jsonl$", 1)
    session = F.regexp_extract(below, r"^([^/]+)/subagents/(?:.+/)?[^/]+\.jsonl$", 1)
    named = F.regexp_extract(below, r"/agent-([^/]+)\.jsonl$", 1)
    agent = F.when(named != "", named).otherwise(F.concat(F.lit("path-"), F.sha2(below, 256)))
    none = F.lit(None).cast("string")
    journal = below.rlike(r"/subagents/workflows/[^/]+/journal\.jsonl$")
    return F.when(main != "", F.struct(main.alias("session_id"), F.lit("main").alias("track_id"), none.alias("agent_id"))).when(
        (session != "") & ~journal,
        F.struct(session.alias("session_id"), F.concat(F.lit("agent:"), agent).alias("track_id"), agent.alias("agent_id")),
    )


def within_cutoff(records: DataFrame, cutoff: Column) -> DataFrame:
    """Records (session_id, track_id, line, raw) of sessions whose main track starts at ``cutoff`` or later;
    those without a date stay, and helpers follow their session."""
    at = timestamp(_get(F.parse_json("raw"), "$.timestamp"))
    start = records.where("track_id = 'main'").groupBy("session_id").agg(F.min_by(at, F.when(at.isNotNull(), F.col("line"))).alias("_start"))
    kept = start.where(F.col("_start") < cutoff).select("session_id")
    return records.join(kept, "session_id", "left_anti")


def timestamp(text: Column) -> Column:
    """An instant, if the text can be read and names its zone; else null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """A string value that is not empty, else null."""
    own = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.when(own, F.nullif(_get(v, path), F.lit("")))


def _string(v: Column, path: str) -> Column:
    """A string value, perhaps empty; null if it is none."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", _get(v, path))


def _tag(text: Column, tag: str) -> Column:
    inside = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(rf"(?s)<{tag}>.*?</{tag}>"), inside)


def _json(v: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


def _tokens(v: Column, path: str) -> Column:
    """Struct of token counts; anything but a whole number from 0 counts as 0; null without usage."""
    one = lambda name: F.coalesce(F.greatest(_get(v, f"{path}.{name}", "long"), F.lit(0)), F.lit(0))
    there = F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT")
    return F.when(there, F.struct(
        one("input_tokens").alias("input"), one("output_tokens").alias("output"),
        one("cache_read_input_tokens").alias("cached"), one("thinking_tokens").alias("thinking"),
    ))


def injection(v: Column) -> Column:
    """What put a user line there, where nobody typed it; the first that holds."""
    is_true = lambda path: F.coalesce(_get(v, path, "boolean"), F.lit(False))
    origin = F.coalesce(_text(v, "$.origin.kind"), _text(v, "$.origin"))
    return (
        F.when(is_true("$.isCompactSummary"), "compactSummary")
        .when(is_true("$.isMeta") & _text(v, "$.sourceToolUseID").isNotNull(), "toolInjection")
        .when(origin == "task-notification", "taskNotification")
        .when(is_true("$.isMeta"), "systemReminder")
    )


def normalise(records: DataFrame) -> DataFrame:
    """Messages of records (session_id, track_id, agent_id, line, raw), one row at least for each line.

    Columns: session_id, track_id, agent_id, line, sub_index, line_uuid, ts, cwd, git_branch, msg_type,
    sub_type, role, content_type, text, call_id, tool_name, input, output, status, command, write_path,
    tokens.  Raw text is redacted first.  A block that is not what it says becomes ``custom``; token counts
    go to the first assistant message of a line, or to a row of their own.
    """
    raw = records.withColumn("raw", redact("raw")).withColumn("v", F.parse_json("raw"))
    v = F.col("v")
    line_type = _text(v, "$.type")
    base = raw.select(
        "session_id", "track_id", "agent_id", "line", "v",
        line_id(_text(v, "$.uuid"), F.to_json(F.struct("session_id", "track_id", "line", "raw"))).alias("line_uuid"),
        timestamp(_text(v, "$.timestamp")).alias("ts"), _text(v, "$.cwd").alias("cwd"), _text(v, "$.gitBranch").alias("git_branch"),
        line_type.alias("line_type"), _string(v, "$.message.content").alias("said"), injection(v).alias("injected"),
        F.schema_of_variant(F.try_variant_get(v, "$.message.content", "variant")).startswith("ARRAY").alias("listed"),
    )
    other = line_type.isin("attachment", "system", "progress", "queue-operation", "frame-link", *PLAIN_LINES)
    talk = base.where(~F.coalesce(other, F.lit(False)))
    rows = _conversation(talk).unionByName(_others(base.where(other)))
    return rows.drop("v", "line_type", "said", "injected", "listed")


_FIELDS = ("sub_index", "msg_type", "sub_type", "role", "content_type", "text", "call_id", "tool_name", "input", "output", "status", "command", "write_path")


def _shaped(df: DataFrame, **fields: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.withColumns({f: fields.get(f, none) for f in _FIELDS})


def _conversation(talk: DataFrame) -> DataFrame:
    v, b, said = F.col("v"), F.col("b"), F.col("said")
    tagged = F.lit(False)
    for tag in COMMAND_TAGS:
        tagged = tagged | F.contains(said, F.lit(f"<{tag}>"))
    tagged = F.coalesce(tagged, F.lit(False))
    blocks = talk.select("*", F.posexplode_outer(F.try_variant_get(v, "$.message.content", "array<variant>")).alias("pos", "b"))
    kind = _text(b, "$.type")
    role = _text(v, "$.message.role")
    role = F.when(role.isin(*ROLES), role).otherwise("unknown")
    whole = said.isNotNull()
    spoken = whole & ~tagged
    source = F.coalesce(_text(b, "$.source.data"), _text(b, "$.source.url"))
    image = (
        (kind == "image") & source.isNotNull() & _get(b, "$.source.type").isin("base64", "url")
        & F.coalesce(_text(b, "$.source.media_type"), _text(b, "$.source.mediaType")).isNotNull()
    )
    text = (kind == "text") & _string(b, "$.text").isNotNull()
    call = (kind == "tool_use") & _text(b, "$.id").isNotNull() & _text(b, "$.name").isNotNull()
    result = (kind == "tool_result") & _text(b, "$.tool_use_id").isNotNull()
    message = spoken | text | (kind == "thinking") | image
    msg_type = (
        F.when(whole & tagged, "localCommand").when(message, "message").when(kind == "fallback", "systemEvent")
        .when(call, "toolCall").when(result, "toolResult").otherwise("custom")
    )
    stated, failed = _text(b, "$.status"), _get(b, "$.is_error", "boolean")
    exit_code = _get(v, "$.exitCode", "long")
    status = F.when(msg_type == "toolResult", F.when(stated.isin("success", "failure", "cancelled", "unknown"), stated).when(failed, "failure").when(~failed, "success").otherwise("unknown"))
    status = F.when(msg_type == "localCommand", F.when(exit_code.isNull(), "unknown").when(exit_code == 0, "success").otherwise("failure")).otherwise(status)
    own_role = F.when(msg_type == "message", F.when(kind == "thinking", "assistant").otherwise(role))
    sub_type = (
        F.when((msg_type == "message") & (own_role == "user"), F.col("injected"))
        .when(msg_type == "systemEvent", "fallback")
        .when((msg_type == "custom") & b.isNotNull(), F.coalesce(kind, F.lit("message.content")))
        .when((msg_type == "custom") & F.col("listed"), "message.content")
        .when(msg_type == "custom", F.coalesce("line_type", F.lit("unknown")))
    )
    rows = _shaped(
        blocks, sub_index=F.coalesce("pos", F.lit(0)), msg_type=msg_type, sub_type=sub_type, role=own_role,
        content_type=F.when(msg_type == "message", F.when(kind == "thinking", "reasoning").when(image, "image").otherwise("text")),
        text=F.when(spoken, said).when(text, _string(b, "$.text")).when(kind == "thinking", _string(b, "$.thinking")).when(image, source)
        .when(msg_type == "localCommand", F.coalesce(_tag(said, "local-command-stdout"), _string(v, "$.stdout"))),
        call_id=F.when(call, _text(b, "$.id")).when(result, _text(b, "$.tool_use_id")),
        tool_name=F.when(call, _text(b, "$.name")), input=F.when(call, _json(b, "$.input")), output=F.when(result, _json(b, "$.content")),
        status=status,
        command=F.when(call & (_text(b, "$.name") == "Bash"), _text(b, "$.input.command"))
        .when(msg_type == "localCommand", F.coalesce(_tag(said, "command-name"), _tag(said, "command-message"), _string(v, "$.command"))),
        write_path=F.when(result, _text(v, "$.toolUseResult.filePath")),
    )
    # usage: struct sorting finds the first assistant message of each line without a window
    usage = _tokens(v, "$.message.usage")
    line = ["session_id", "track_id", "line"]
    rows = rows.withColumn("_usage", F.when(msg_type != "localCommand", usage)).drop("pos", "b")
    speaks = (F.col("msg_type") == "message") & (F.col("role") == "assistant")
    used = rows.where("_usage is not null").groupBy(*line).agg(
        F.min(F.when(speaks, F.col("sub_index"))).alias("_at"), (F.max("sub_index") + 1).alias("_next")
    )
    met = rows.join(used, line, "left")
    held = met.withColumn("tokens", F.when(F.col("sub_index") == F.col("_at"), F.col("_usage")))
    extra = met.where("_next is not null and _at is null and sub_index = _next - 1")
    extra = _shaped(extra.withColumn("_n", F.col("_next")), sub_index=F.col("_n"), msg_type=F.lit("usage"), sub_type=F.lit("tokens")).withColumn("tokens", F.col("_usage"))
    return held.drop("_usage", "_at", "_next").unionByName(extra.drop("_usage", "_at", "_next", "_n"))


def _others(lines: DataFrame) -> DataFrame:
    v, t = F.col("v"), F.col("line_type")
    inner = F.when(t == "attachment", F.try_variant_get(v, "$.attachment", "variant")).when(t == "progress", F.try_variant_get(v, "$.data", "variant")).otherwise(v)
    lines = lines.withColumn("w", inner)
    w = F.col("w")
    kind = F.when(t == "system", F.coalesce(_text(v, "$.subtype"), F.lit("system"))).otherwise(F.coalesce(_text(w, "$.type"), t))
    path = F.coalesce(_text(w, "$.filename"), _text(w, "$.path"))
    carried = t.isin("attachment", "progress")
    hook = carried & kind.isin(*HOOKS)
    call_id = F.coalesce(_text(w, "$.toolUseID"), _text(w, "$.toolUseId"), _text(w, "$.toolCallId"))
    stdout, stderr = _string(w, "$.stdout"), _string(w, "$.stderr")
    elapsed = F.coalesce(_get(w, "$.elapsedMs", "double"), _get(w, "$.elapsedTimeSeconds", "double") * 1000)
    moves = (t == "progress") & _text(w, "$.type").isNotNull() & (call_id.isNotNull() | stdout.isNotNull() | stderr.isNotNull() | elapsed.isNotNull())
    queued = (t == "attachment") & (kind == "queued_command") & _string(w, "$.prompt").isNotNull()
    file = (t == "attachment") & kind.isin("edited_text_file", "file", "already_read_file", "opened_file_in_ide", "selected_lines_in_ide") & path.isNotNull()
    linked = (t == "frame-link") & F.coalesce(_text(v, "$.path"), _text(v, "$.url")).isNotNull()
    budget = (kind == "budget_usd") & _get(w, "$.used", "double").isNotNull() & _get(w, "$.total", "double").isNotNull()
    system = t == "system"
    msg_type = (
        F.when(hook, "hookCall").when(queued, "message").when(moves | ((t == "attachment") & (kind == "read_truncation_notice")), "progress")
        .when(file | linked, "fileEvent").when((t == "attachment") & budget, "usage").when(t == "queue-operation", "queueOperation")
        .when(system & (kind == "stop_hook_summary"), "hookCall").when(system & (kind == "turn_duration"), "turnEvent")
        .when(system & (kind == "compact_boundary"), "compaction").when(system & (kind == "local_command"), "localCommand")
        .when(t.isin(*PLAIN_LINES) | (system & kind.isin(*NOTICES)) | ((t == "attachment") & kind.isin(*PLAIN_ATTACHMENTS)), "systemEvent")
        .otherwise("custom")
    )
    notified = queued & (_text(w, "$.commandMode") == "task-notification")
    done = F.when(kind == "hook_success", "success").when(kind == "hook_cancelled", "cancelled").when(kind == "hook_non_blocking_error", "failure")
    sub_type = F.when(msg_type == "message", F.when(notified, "taskNotification")).when(t == "queue-operation", _text(v, "$.operation")).otherwise(kind)
    said = _string(v, "$.content")
    return _shaped(
        lines, sub_index=F.lit(0), msg_type=msg_type, sub_type=sub_type, role=F.when(queued, "user"),
        content_type=F.when(queued, "text"),
        text=F.when(queued, _string(w, "$.prompt")).when(F.col("line_type") == "progress", stdout).when(msg_type == "localCommand", _tag(said, "local-command-stdout")),
        call_id=F.when(msg_type.isin("progress", "hookCall"), call_id), status=F.when(hook, done),
        command=F.when(msg_type == "localCommand", F.coalesce(_tag(said, "command-name"), _tag(said, "command-message"))).when(hook, _string(w, "$.command")),
        write_path=F.when(file, path).when(linked, F.coalesce(_text(v, "$.path"), _text(v, "$.url"))),
    ).withColumn("tokens", F.lit(None).cast("struct<input:bigint,output:bigint,cached:bigint,thinking:bigint>")).drop("w")


def titles(records: DataFrame) -> DataFrame:
    """(session_id, title): the last title a person gave, else the last the agent made."""
    v = F.parse_json("raw")
    own, made = F.trim(_text(v, "$.customTitle")), F.trim(_text(v, "$.aiTitle"))
    own = F.when((_text(v, "$.type") == "custom-title") & (own != ""), own)
    made = F.when((_text(v, "$.type") == "ai-title") & (made != ""), made)
    return records.where("track_id = 'main'").groupBy("session_id").agg(
        F.coalesce(F.max_by(own, F.when(own.isNotNull(), F.col("line"))), F.max_by(made, F.when(made.isNotNull(), F.col("line")))).alias("title")
    )


def coverage(lines: DataFrame, records: DataFrame, messages: DataFrame) -> DataFrame:
    """Per track: source lines, parsed records and messages, for an audit that nothing was lost."""
    key = ["session_id", "track_id"]
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    out = n(lines, "lines").join(n(records, "records"), key, "left").join(n(messages, "messages"), key, "left")
    return out.fillna(0, ["records", "messages"])


def sidecars(transcripts: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, agent_id, agent_type, description, spawn_depth, spawn_tool_use_id) of every helper's transcript.

    ``transcripts`` has path, ``metadata`` path and raw, the JSON beside it.  Without a sidecar, or with one
    that is no JSON object, only the id is known; values of another type than told count as absent.
    """
    name = F.element_at(F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/"), -1)
    helper = name.startswith("agent-") & name.endswith(".jsonl") & (F.length(name) > len("agent-.jsonl"))
    mine = transcripts.where(helper).select(
        "path", F.substring(name, F.lit(7), F.length(name) - 12).alias("agent_id"),
        F.concat(F.left("path", F.length("path") - len(".jsonl")), F.lit(".meta.json")).alias("_meta"),
    )
    beside = metadata.select(F.col("path").alias("_meta"), F.try_parse_json("raw").alias("v"))
    met = mine.join(beside, "_meta", "left")

    def told(field: str, kind: str) -> Column:
        value = F.try_variant_get("v", f"$.{field}", "variant")
        typed = F.schema_of_variant(value).rlike(kind)
        return F.when(typed, F.try_variant_get("v", f"$.{field}", "string"))

    text = lambda field: F.nullif(told(field, "^STRING$"), F.lit(""))
    depth = told("spawnDepth", "^(BIGINT|DECIMAL|DOUBLE)").try_cast("double")
    return met.select(
        "path", "agent_id", text("agentType").alias("agent_type"), told("description", "^STRING$").alias("description"),
        F.when((depth >= 0) & (depth == F.floor(depth)), depth.cast("int")).alias("spawn_depth"),
        F.coalesce(text("toolUseId"), text("spawnToolUseId")).alias("spawn_tool_use_id"),
    )
