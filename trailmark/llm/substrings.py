"""Suffix-array dedup: bytes covered by a string of ``span`` bytes that starts elsewhere as well.

Sorting every suffix of a corpus would move far more than the corpus, so a sparse suffix array is
built.  Of every window of ``span`` bytes the GRAM bytes with the smallest hash are its anchor; equal
windows have their anchor at the same place, so a repeated window shows as two anchors with equal
surroundings.  Anchors whose GRAM occurs once are dropped by an exact count.  The rest are suffixes:
tasks sort theirs into runs, front-code them, exchange the runs by ranges of the order, and merge them
with loser trees that go by known common prefixes.  In the merged order the common prefix with
other suffixes tells how far a match runs to the right; what lies left of the anchors, how far to the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, parts, settle, text_of
from .simhash import whole_groups
from .toxicity import utf8

SPAN, GRAM = 200, 32
_HASH = 8  # a suffix's sort key starts with the spread hash of its gram, so that ranges come out even
#: Suffixes of one sorted run at most, and bytes whose anchors are looked for at once.
RUN, CHUNK = 12_000, 1 << 18

_BYTE = np.random.default_rng(200).integers(0, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _spread(h: np.ndarray) -> np.ndarray:
    """Gram hashes one to one over the whole range: anchors are the smallest of many, so theirs are small."""
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h * _BASE


def _times(exponent: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), exponent, 2**64))


def anchors(data: np.ndarray, starts: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the anchors of all windows inside the texts cut at ``starts``."""
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < span:
        return none
    h, size = _BYTE[data], 1
    while size < GRAM:
        h = h[:-size] * _times(size) + h[size:]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the order of grams, then their position: the minimum is the leftmost smallest gram
    low = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    grams, reach = span - GRAM + 1, 1
    while 2 * reach <= grams:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < grams:
        low = np.minimum(low[: -(grams - reach)], low[grams - reach :])
    inside = np.zeros(n + 1, np.int32)
    first = starts[:-1][np.diff(starts) >= span]
    last = starts[1:][np.diff(starts) >= span] - span + 1
    if not len(first):
        return none
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    valid = np.cumsum(inside[: len(low)]) > 0
    at = (low[valid] & ~_HIGH).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def _chunks(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(_d, _t, _text, keep...): tables are dealt by _d, a hash of doc_id and text, and what is removed
    also needs the same _t, another hash of the text.

    Rows that share both have the same text, so what is removed from one is removed from all.
    """
    text = text_of(docs)
    return docs.select(
        F.xxhash64(docs["doc_id"].cast("long"), text).alias("_d"),
        F.xxhash64(F.lit(SPAN), text).alias("_t"),
        text.alias("_text"),
        *[docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)],
    )


def _grams(texts: DataFrame, span: int) -> DataFrame:
    """(_d, gram, n): the anchors of each text by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            d = batch.column(0).to_numpy()
            for i, j in _chunks(starts):
                at, h = anchors(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], span)
                if not len(at):
                    continue
                owner = np.searchsorted(starts, at + starts[i], "right") - 1
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])
                begin = np.flatnonzero(new)
                n = np.diff(np.append(begin, len(h)))
                owner = owner[begin]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[owner]), pa.array(h[begin].view(np.int64)), pa.array(n.astype(np.int32))],
                    ["_d", "gram", "n"],
                )

    return map_arrow(texts.select("_d", "_text"), run, "_d long, gram long, n int")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(a), len(b))
    x = int.from_bytes(a[known:end]) ^ int.from_bytes(b[known:end])
    return end - (x.bit_length() + 7) // 8


def front_code(entries: list[tuple]) -> bytes:
    """Sorted (key, left, d, t, at) as bytes: a key as what it adds to the one before."""
    lcp, rest, before = [], [], b""
    for key, *_ in entries:
        lcp.append(common_prefix(before, key))
        rest.append(key[lcp[-1] :])
        before = key
    left = [e[1] for e in entries]
    numbers = np.array([e[2:] for e in entries], np.int64)
    sizes = np.array([lcp, list(map(len, rest)), list(map(len, left))], np.uint16)
    head = np.array([len(entries)], np.int64)
    raw = b"".join([head.tobytes(), numbers.tobytes(), sizes.tobytes(), *rest, *left])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def read_run(run: bytes) -> Iterator[tuple]:
    """(key, lcp with the key before, left, d, t, at) of a front-coded run, in order."""
    run = pa.decompress(run[8:], int.from_bytes(run[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(run, np.int64, 1)[0])
    numbers = np.frombuffer(run, np.int64, 3 * n, 8).reshape(n, 3).tolist()
    lcp, rest, left = np.frombuffer(run, np.uint16, 3 * n, 8 + 24 * n).reshape(3, n).tolist()
    at = 8 + 30 * n
    lefts = at + sum(rest)
    key = b""
    for k in range(n):
        key = key[: lcp[k]] + run[at : at + rest[k]]
        at += rest[k]
        yield (key, lcp[k], run[lefts : lefts + left[k]], *numbers[k])
        lefts += left[k]


def merge_runs(runs: list[bytes]) -> Iterator[tuple]:
    """The entries of all runs in order, each with its key's common prefix with the one before.

    A loser tree.  Every waiting entry knows its common prefix with the last entry given out; of two
    entries the one with the longer prefix is smaller, and only equal prefixes are compared, from
    their end on.
    """
    streams = list(map(read_run, runs))
    width = 1
    while width < len(streams):
        width *= 2
    head: list[tuple | None] = [next(s, None) for s in streams] + [None] * (width - len(streams))
    prefix = [0 if h else -1 for h in head]  # an ended stream loses against all
    losers = [0] * width

    def beats(a: int, b: int) -> bool:
        """Whether a's entry comes before b's; sets the loser's prefix to that with the winner."""
        x, y = prefix[a], prefix[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        p, q = head[a][0], head[b][0]
        end = common_prefix(p, q, x)
        if p[end : end + 1] <= q[end : end + 1]:
            prefix[b] = end
            return True
        prefix[a] = end
        return False

    def build(node: int) -> int:
        if node >= width:
            return node - width
        a, b = build(2 * node), build(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    best = build(1)
    while prefix[best] >= 0:
        key, _, *rest = head[best]
        yield (key, prefix[best], *rest)
        head[best] = after = next(streams[best], None)
        prefix[best] = after[1] if after else -1
        node = (best + width) // 2
        while node:
            other = losers[node]
            if not beats(best, other):
                losers[node], best = best, other
            node //= 2


def reaches(lcp: list[int], lefts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes of one gram in order: how far bytes left and right of each anchor are repeated.

    ``lcp[i]``: common bytes right of anchors i-1 and i (lcp[0] is not used).  A window that starts o
    bytes left of the anchor is repeated if another suffix shares o bytes to the left and span - o to
    the right; both results are 0 where there is none.
    """
    m = len(lefts)
    left, right = np.zeros(m, np.int64), np.zeros(m, np.int64)
    if m <= 12:
        for i in range(m):
            r = span
            for j in range(i + 1, m):
                r = min(r, lcp[j])
                common = common_prefix(lefts[i], lefts[j])
                if common + r >= span:
                    left[i], left[j] = max(left[i], common), max(left[j], common)
                    right[i], right[j] = max(right[i], r), max(right[j], r)
        return left, right
    r = np.array([0, *lcp[1:], 0])
    order = sorted(range(m), key=lefts.__getitem__)
    common = [common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)]
    c = np.array([0, *common, 0])
    most_left = np.zeros(m, np.int64)
    most_left[order] = np.maximum(c[:-1], c[1:])
    # only suffixes with neighbours that share enough on both sides can be repeated
    hope = np.flatnonzero(np.maximum(r[:-1], r[1:]) + most_left >= span)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    for o in range(span - GRAM + 1) if len(hope) else ():
        by_right = np.cumsum(r[:-1] < span - o)[hope]
        by_left = np.cumsum(c[:-1] < o)[place[hope]]
        _, inverse, n = np.unique(by_right * (m + 1) + by_left, return_inverse=True, return_counts=True)
        twice = hope[n[inverse] > 1]
        left[twice] = o
        right[twice] = np.maximum(right[twice], span - o)
    return left, right


def _runs(met: DataFrame, buckets: int, span: int) -> DataFrame:
    """(bucket, run, d, t, start, end): front-coded runs by range of the order, and what a task knows
    without the others: surroundings that occur twice among its own texts are repeated as they are."""
    back = span - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, bytes], list] = {}
        held = 0
        for batch in batches:
            data, starts = utf8(batch.column("_text"))
            d, t = batch.column("_d").to_pylist(), batch.column("_t").to_pylist()
            wanted = batch.column("grams")
            for i, j in _chunks(starts):
                at, h = anchors(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], span)
                at = at + starts[i]
                cut = np.searchsorted(at, starts[i : j + 1])
                for k in range(i, j):
                    a, b = cut[k - i], cut[k - i + 1]
                    if a == b:
                        continue
                    some = np.isin(h[a:b].view(np.int64), np.asarray(wanted[k].as_py(), np.int64))
                    if not some.any():
                        continue
                    text = data[starts[k] : starts[k + 1]].tobytes()
                    flipped = text[::-1]
                    size = len(text)
                    keys = _spread(h[a:b][some]).astype(">u8").tobytes()
                    for x, p in enumerate((at[a:b][some] - starts[k]).tolist()):
                        key = keys[8 * x : 8 * x + 8] + text[p : p + span]
                        seen.setdefault((key, flipped[size - p : size - p + back]), []).append((d[k], t[k], p))
                        held += 1
                if held >= RUN:
                    yield from _made(seen, buckets)
                    seen, held = {}, 0
        if seen:
            yield from _made(seen, buckets)

    schema = "bucket int, run binary, d array<long>, t array<long>, start array<long>, end array<long>"
    return map_arrow(met, run, schema)  # all columns, so that the exchange of the texts is used twice


_LONGS = pa.list_(pa.int64())


def _made(seen: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    order = sorted(seen)
    by: dict[int, list] = {}
    known: dict[int, list] = {}
    for key, left in order:
        places = seen[key, left]
        bucket = int.from_bytes(key[:_HASH]) * buckets >> 64
        d, t, p = places[0] if len(places) == 1 else (0, 0, -1)
        by.setdefault(bucket, []).append((key, left, d, t, p))
        if len(places) > 1:
            for d, t, p in places:
                known.setdefault(d % buckets, []).append((d, t, p - len(left), p + len(key) - _HASH))
    rows = [(b, front_code(entries), [], [], [], []) for b, entries in by.items()]
    rows += [(b, None, *map(list, zip(*some, strict=True))) for b, some in known.items()]
    kinds = [pa.int32(), pa.binary(), _LONGS, _LONGS, _LONGS, _LONGS]
    for i in range(0, len(rows), 512):
        columns = zip(*rows[i : i + 512], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["bucket", "run", "d", "t", "start", "end"],
        )


def _merged(runs: DataFrame, buckets: int, span: int) -> DataFrame:
    """(_d, _t, start, end): repeated bytes of each text, from the merged runs of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1, 1):
            bucket = table.column(0).to_numpy()
            first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            passed = [table.column(k).combine_chunks().flatten() for k in (2, 3, 4, 5)]
            if len(passed[0]):
                yield pa.RecordBatch.from_arrays(passed, ["_d", "_t", "start", "end"])
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                found = _repeats([r for r in table.column(1).slice(a, b - a).to_pylist() if r], span)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*found, strict=True)],
                        ["_d", "_t", "start", "end"],
                    )

    dealt = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, run, "_d long, _t long, start long, end long")


def _repeats(runs: list[bytes], span: int) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    group: list[tuple] = []

    def close() -> None:
        if len(group) > 1:
            left, right = reaches([e[1] - _HASH for e in group], [e[2] for e in group], span)
            for k in np.flatnonzero(left + right >= span).tolist():
                _, _, _, d, t, p = group[k]
                if p >= 0:  # else a task that has it twice has given it already
                    out.append((d, t, p - int(left[k]), p + int(right[k])))

    for entry in merge_runs(runs):
        if entry[1] < _HASH + GRAM:
            close()
            group = []
        group.append(entry)
    close()
    return out


def repeated(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(_d, spans): the repeated bytes of keyed texts as structs of _t, start and end."""
    spark = texts.sparkSession
    grams = settle(_grams(texts, span))
    often = grams.groupBy("gram").agg(F.sum(F.col("n").cast("long")).alias("all")).where("all > 1").select("gram")
    wanted = grams.join(often, "gram").groupBy("_d").agg(F.collect_set("gram").alias("grams"))
    met = texts.join(wanted, "_d")
    buckets = parts(spark, 4)
    found = _merged(_runs(met, buckets, span), buckets, span)
    return found.groupBy("_d").agg(F.collect_set(F.struct("_t", "start", "end")).alias("spans"))


def union_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that any span covers."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def _cut(docs: DataFrame, keep: list[str], span: int, row, fields: str) -> DataFrame:
    """Runs ``row`` (a text's bytes, what is left of them, removed runs) over every row of ``docs``."""
    texts = _keyed(docs, keep)
    met = texts.join(repeated(texts, span), "_d", "left").drop("_d")
    types = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([f"`_keep{i}` {t}" for i, t in enumerate(types)] + [fields])
    names = [f"_keep{i}" for i in range(len(keep))] + [f.split()[0] for f in fields.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    out_types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column("_text"))
            rows = []
            own = batch.column("_t").to_pylist()
            for k, spans in enumerate(batch.column("spans")):
                text = data[starts[k] : starts[k + 1]].tobytes()
                gone = union_spans([x for x in spans.as_py() or [] if x["_t"] == own[k]])
                if gone:
                    edges = [0, *(x for s in gone for x in s), len(text)]
                    left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                else:
                    left = text
                rows.append(row(text, left, gone))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_types, strict=True)] if rows else [
                pa.array([], t) for t in out_types
            ]
            kept = [batch.column(f"_keep{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names)

    out = map_arrow(met, run, schema)
    return out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *names[len(keep) :])


def dedup_digest(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    Null text is empty; texts under ``span`` bytes lose nothing; rows repeated as a whole are documents
    of their own and so repeat each other; a null doc_id stays null.  An empty table gives no rows, and
    other columns, whatever their names, are left behind.
    """

    def row(text: bytes, left: bytes, gone: list) -> tuple:
        return len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest()

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _cut(docs, ["doc_id"], span, row, fields)


def remove_repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text`` and ``n_chars``, if there, counted again.

    A character that loses some of its bytes goes as a whole.  Null text that loses nothing is given
    back as empty.  Documents stay, even with nothing left.
    """

    def row(text: bytes, left: bytes, gone: list) -> tuple:
        return (left.decode("utf-8", "ignore"),)

    out = _cut(docs, [c for c in docs.columns if c != "text"], span, row, "_left string")
    out = out.withColumnRenamed("_left", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
