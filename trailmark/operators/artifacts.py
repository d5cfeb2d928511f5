"""Files that sessions write: folded writes, the upload queue, references followed, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.content import references
from ..tables import settled

#: Messages of one request, characters and keys of a call's summary, attempts of an upload.
CHUNK, SUMMARY, ATTEMPTS = 500, 200, 5
SUMMARY_KEYS = ("command", "file_path", "path", "query", "pattern", "prompt", "description")


def writes(events: DataFrame) -> DataFrame:
    """(session_id, path, created, base): writes (session_id, path, created, base, at, pos) folded by path.

    A file is the session's own if any write created it.  Its base is that of the earliest write that has one,
    but of those until one created it: what is seen later is the session's output.
    """
    own = Window.partitionBy("session_id", "path").orderBy(F.coalesce("at", F.timestamp_seconds(F.lit(0))), "pos")
    before = F.coalesce(F.max(F.col("created").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    usable = (before == 0) & ~(F.col("created") & (F.row_number().over(own) > 1)) & F.col("base").isNotNull()
    marked = events.withColumns({"_usable": usable, "_n": F.row_number().over(own)})
    return marked.groupBy("session_id", "path").agg(
        F.bool_or("created").alias("created"), F.min_by(F.when(F.col("_usable"), F.col("base")), F.when(F.col("_usable"), F.col("_n"))).alias("base")
    )


def enqueue(queue: DataFrame, fresh: DataFrame) -> DataFrame:
    """The queue after sightings in order ``at``: the latest content, the folded base, the most attempts, and
    a backoff that a new sighting does not reset.  Columns: session_id, path, content, created, base,
    attempts, next_attempt_at, at."""
    every = queue.unionByName(fresh)
    folded = writes(every.select("session_id", "path", "created", "base", F.timestamp_seconds("at").alias("at"), F.col("at").alias("pos")))
    last = every.groupBy("session_id", "path").agg(
        F.max_by("content", "at").alias("content"), F.max("attempts").alias("attempts"),
        F.min_by("next_attempt_at", F.when(F.col("next_attempt_at").isNotNull(), F.col("at"))).alias("next_attempt_at"), F.max("at").alias("at"),
    )
    return last.join(folded, ["session_id", "path"]).select(queue.columns)


def settle_uploads(queue: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """The queue after uploads (session_id, path, at): entries that did not change meanwhile go when done;
    failed ones get an attempt more and go after ATTEMPTS."""
    key = ["session_id", "path", "at"]
    rest = queue.join(done.select(*key), key, "left_anti").join(failed.select(*key, F.lit(1).alias("_f")).distinct(), key, "left")
    return rest.withColumn("attempts", F.col("attempts") + F.coalesce("_f", F.lit(0))).where(F.col("attempts") < ATTEMPTS).drop("_f")


def closure(start: DataFrame, files: DataFrame) -> DataFrame:
    """(path): the files (path, content) that ``start`` (path) leads to by references, itself included.

    Level by level until no new file is met; only new files go on.  Paths are compared as written, relative to
    the root.
    """
    links = settled(files.select("path", F.explode(references(F.col("content"))).alias("to")).join(files.select(F.col("path").alias("to")), "to", "left_semi"))
    seen = level = settled(start.select("path").distinct())
    while not level.isEmpty():
        level = settled(links.join(level, "path", "left_semi").select(F.col("to").alias("path")).distinct().join(seen, "path", "left_anti"))
        seen = settled(seen.unionByName(level))
    return seen


def chunks(records: DataFrame, by: list[str], order: list[str], size: str, most: int = CHUNK) -> DataFrame:
    """``records`` with ``pack``, the request they go in: filled to ``most`` messages, larger ones alone."""
    from .runs import pack

    return pack(records, by, order, size, most)


def summarise_input(text: Column) -> Column:
    """What a call was about: the first of the telling keys of its JSON input, in one line."""
    v = F.try_parse_json(text)
    first = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in SUMMARY_KEYS], F.lit(""))
    return F.substring(F.regexp_replace(first, r"\s+", " "), 1, SUMMARY)


def listing(artifacts: DataFrame) -> DataFrame:
    """(path, bytes, has_base, text): sizes and texts of artifacts (path, content, base, is_binary); binary
    bytes are withheld."""
    return artifacts.select(
        "path", F.octet_length("content").alias("bytes"), F.col("base").isNotNull().alias("has_base"),
        F.when(~F.col("is_binary"), F.decode("content", "UTF-8")).alias("text"),
    )


def tree(paths: DataFrame) -> DataFrame:
    """(folder, name, is_folder): entries of folders, folders first; chains of folders with one child only
    are one entry."""
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(1), F.size(parts))
    every = paths.select(F.explode(F.transform(levels, lambda n: F.struct(
        F.array_join(F.slice(parts, 1, n - 1), "/").alias("folder"), F.array_join(F.slice(parts, 1, n), "/").alias("full"), (n < F.size(parts)).alias("is_folder")
    ))).alias("e")).select("e.*").distinct()
    alone = every.groupBy("folder").agg(F.count("*").alias("n"), F.bool_and("is_folder").alias("all")).where("n = 1 and all and folder <> ''")
    # the one child of a folder stands in its place
    up = every.join(alone.select(F.col("folder").alias("full"), F.lit(True).alias("_skip")), "full", "left").where("_skip is null").drop("_skip")
    shown = up.select(F.col("full").alias("_f")).where("_f is not null").distinct()
    home = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("full", "/"))), lambda n: F.array_join(F.slice(F.split("full", "/"), 1, F.size(F.split("full", "/")) - n), "/")), lambda x: x != "")
    at = up.select("full", "is_folder", F.posexplode_outer(home).alias("far", "above")).join(shown, F.col("above") == F.col("_f"), "left")
    near = at.groupBy("full", "is_folder").agg(F.coalesce(F.min_by("_f", F.when(F.col("_f").isNotNull(), F.col("far"))), F.lit("")).alias("folder"))
    name = F.when(F.col("folder") == "", F.col("full")).otherwise(F.substr("full", F.length("folder") + 2))
    return near.select("folder", name.alias("name"), "is_folder").orderBy("folder", F.col("is_folder").desc(), "name")
