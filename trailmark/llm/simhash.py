"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that can be near meet in a bucket.  Buckets lie one after another in a batch, and bit b
of all fingerprints is stored as one plane, 64 rows a machine word.  A plane XORed with itself moved
by s rows has the differences of 64 pairs (i, i+s) in a word; carry-save counters add the planes up
for all pairs at once, and words whose pairs all exceed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, forget, map_arrow, parts, settle, text_of
from .components import components

#: Fixed value: the seed of the shingles' XXH64.
SEED = 42
#: Rows of one bucket that are compared in one piece; larger buckets are cut, and the cuts paired.
PIECE = 4096
#: Shingles of the texts of one cut of a cluster, about.
CLUSTER = 1 << 18
#: Sets of at least SMALL shingles that are alike to 0.8 differ in more than GATE bits of 64, or WIDE_GATE of 64 x WORDS,
#: once in 10^8 pairs, and are compared by bits first; smaller sets are always compared as a whole.
WORDS, GATE, WIDE_GATE, SMALL = 4, 28, 74, 16
#: Shingles known to be frequent at most (the most frequent ones), shingles counted at once, and the least count there.
FREQUENT, COUNTED, OFTEN = 1 << 17, 1 << 22, 3
#: Rows of a table of ids that is broadcast at most; the driver holds it several times over while it is made.
SENT = 1 << 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lower-cased, joined by single spaces.

    Fewer words give the hash of them all, no word gives none.
    """
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()  # ASCII letters and white space only, as bytes
    if len(w) <= words:
        joined = [b" ".join(w)] if w else []
    else:
        joined = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.array([xxh64_intdigest(x, SEED) for x in joined], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash as a signed long: a bit is 1 if set in over half the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(ones).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of every whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(text.as_py(), words)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")), run, "doc_id long, fp long")


def block_keys(fp: Column, radius: int) -> Column:
    """Buckets that any two fingerprints within ``radius`` share at least one of.

    64 bits are cut in radius + 2 blocks; at least two blocks are free of differences, so a bucket
    is a pair of blocks and what they hold.
    """
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    cut = [
        F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        for a, b in zip(edges, edges[1:], strict=False)
    ]
    width = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    pairs = [(i, j) for i in range(n) for j in range(i)]
    return F.array(*[
        F.lit(k << 2 * width).bitwiseOR(F.shiftleft(cut[i], width)).bitwiseOR(cut[j])
        for k, (i, j) in enumerate(pairs)
    ])


class Planes:
    """Bit planes of fingerprints of one or several 64-bit words, in eight copies that are moved by 0 to 7 rows."""

    def __init__(self, fps: np.ndarray):
        n = self.n = len(fps)
        bits = np.unpackbits(fps.reshape(n, -1).astype(">u8").view(np.uint8), axis=1).T
        self.bytes = -(-n // 64) * 8
        self.copies = np.zeros((8, len(bits), 2 * self.bytes), np.uint8)
        for moved in range(8):
            packed = np.packbits(bits[:, moved:], axis=1)
            self.copies[moved, :, : packed.shape[1]] = packed

    def near(self, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
        """Rows i with valid[i] whose fingerprint differs from that of row i+shift in radius bits at most."""
        over = ~_packed(valid, self.bytes)
        words = np.flatnonzero(over != np.uint64(2**64 - 1))
        over = over[words]
        count = max(1, radius.bit_length())
        # counters start so that they overflow with one difference more than the radius
        start = (1 << count) - 1 - radius
        held = [np.full(len(words), 2**64 - 1 if start >> k & 1 else 0, np.uint64) for k in range(count)]
        here, there = self.copies[0], self.copies[shift % 8]
        byte = shift // 8
        for plane in range(len(here)):
            a = here[plane, : self.bytes].view(np.uint64)[words]
            b = there[plane, byte : byte + self.bytes].copy().view(np.uint64)[words]
            carry = a ^ b
            for k in range(count):
                held[k], carry = held[k] ^ carry, held[k] & carry
            over |= carry
            if plane % 8 == 7:
                alive = over != np.uint64(2**64 - 1)
                if not alive.all():
                    words, over, held = words[alive], over[alive], [h[alive] for h in held]
                if not len(words):
                    return np.zeros(0, np.int64)
        found = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1)
        row, bit = np.nonzero(found)
        return words[row] * 64 + bit


def _packed(flags: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint8)
    packed = np.packbits(flags)
    out[: len(packed)] = packed
    return out.view(np.uint64)


def roots(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable row of each of n rows under links (u, v) and earlier ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def compare(
    fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int, sizes: np.ndarray | None = None, least: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near in each group of rows (which lie together): a forest.

    ``side``: 0 compares the row with its whole group, 1 and 2 only with the other of them.  With the
    ``sizes`` of sets, those that cannot have a similarity of ``least`` are not near.
    """
    n = len(fps)
    first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
    counts = np.diff(first)
    # groups of about one size are compared together, the larger ones first, so that a larger shift looks at
    # fewer rows, and a large group that is linked up needs no more shifts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 1]
    u, v = [], []
    at = 0
    while at < len(order):
        end = at + 1
        held = int(counts[order[at]])
        while end < len(order) and held < 1 << 16 and 2 * counts[order[end]] > counts[order[at]]:
            held += int(counts[order[end]])
            end += 1
        some = order[at:end]
        at = end
        rows = np.repeat(first[some] - np.cumsum(counts[some]) + counts[some], counts[some]) + np.arange(held)
        a, b = _compare(fps[rows], counts[some], side[rows], radius, sizes[rows] if sizes is not None else None, least)
        u.append(rows[a])
        v.append(rows[b])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(u or none), np.concatenate(v or none)


def _compare(fps, counts, side, radius, sizes, least) -> tuple[np.ndarray, np.ndarray]:
    """The links inside groups that lie together, ``counts`` rows each, the largest group first."""
    n = len(fps)
    left = np.concatenate([np.arange(c, 0, -1) for c in counts])
    top = np.cumsum(counts)
    label = np.arange(n)
    starts = top - counts
    planes = Planes(fps)
    fresh = False
    for shift in range(1, int(counts[0])):
        if fresh and bool((np.maximum.reduceat(label, starts) == np.minimum.reduceat(label, starts)).all()):
            break
        fresh = False
        reach = int(top[np.searchsorted(-counts, -shift, "left") - 1])
        valid = left[:reach] > shift
        m = reach - shift
        valid[:m] &= (side[:m] == 0) | (side[:m] != side[shift:reach])
        # what is linked already needs no second link
        valid[:m] &= label[:m] != label[shift:reach]
        valid[m:] = False
        if sizes is not None:
            low, high = np.minimum(sizes[:m], sizes[shift:reach]), np.maximum(sizes[:m], sizes[shift:reach])
            valid[:m] &= low >= least * high
        i = planes.near(shift, valid, radius)
        if len(i):
            label = roots(n, i, i + shift, label)
            fresh = True
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def links(rows: DataFrame, radius: int, piece: int = PIECE) -> DataFrame:
    """(u, v) that connect all near nodes of (bucket, node, fp) rows, bucket by bucket.

    Buckets of one row go.  A bucket of more than ``piece`` rows is cut by a hash of the node, and
    every two cuts are compared in a task of their own, so a hot bucket is spread out and a task
    holds two cuts at most.  What comes out of a task is a forest, never all pairs.
    """
    many = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    cuts = F.ceil(F.col("n") / piece).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    met = (
        rows.join(many, "bucket")
        .withColumn("cuts", cuts)
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("lo") == F.col("hi"), 0).when(F.col("own") == F.col("lo"), 1).otherwise(2))
    )
    return compared(met, radius)


def compared(met: DataFrame, radius: int) -> DataFrame:
    """(u, v) that connect what is near in each (bucket, lo, hi) of rows with side, node and fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, group in _grouped(batches):
            side, node, fp = (whole.column(k).to_numpy() for k in (3, 4, 5))
            u, v = compare(fp.view(np.uint64), group, side, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return map_arrow(_dealt(met, "fp"), run, "u long, v long")


def _dealt(met: DataFrame, *more: str) -> DataFrame:
    keys = ["bucket", "lo", "hi"]
    met = met.select(*keys, "side", "node", *more).repartition(parts(met.sparkSession), *keys)
    return met.sortWithinPartitions(*keys, "node")


def _grouped(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups by (bucket, lo, hi), and the group of each row."""
    for whole in whole_groups(batches, 3, least):
        bucket, lo, hi = (whole.column(k).to_numpy() for k in range(3))
        change = np.ones(len(bucket), bool)
        change[1:] = (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        yield whole, np.cumsum(change)


def _near_sets(whole: pa.Table, group: np.ndarray, fps: np.ndarray, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are linked by their bits, or by being small (``exact``), if their sizes allow them to be alike."""
    side, node, size = (whole.column(k).to_numpy() for k in (3, 4, 5))
    exact = whole.column(6).to_numpy()
    new = np.ones(len(node), bool)  # one node is once in a group and side
    new[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1]) | (side[1:] != side[:-1])
    u, v = [], []
    for which, bits in ((new & exact, 64 * WORDS), (new & ~exact, radius)):
        at = np.flatnonzero(which)
        if len(at) > 1:
            a, b = compare(fps[at], group[at], side[at], bits, size[at], least)
            u.append(at[a])
            v.append(at[b])
    if not u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(u), np.concatenate(v)
    other = node[u] != node[v]
    return u[other], v[other]


def near_sets(met: DataFrame, prints: DataFrame, gate: int, wide_gate: int, least: float) -> DataFrame:
    """(u, v) that connect the sets that are near in each (bucket, lo, hi) of rows with side, node, fp, size and exact.

    Rows are compared by the 64 bits of ``fp`` first; only those left with a partner get their ``wide`` fingerprint
    of ``prints`` (node, wide) and are compared by it.  ``prints`` is as long as the corpus, so it is shuffled, not broadcast.
    """
    keys = ["bucket", "lo", "hi", "side", "node", "size", "exact"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, group in _grouped(batches):
            u, v = _near_sets(whole, group, whole.column("fp").to_numpy().view(np.uint64), gate, least)
            if len(u):
                at = np.unique(np.concatenate([u, v]))
                yield whole.select(keys).take(pa.array(at)).combine_chunks().to_batches()[0]

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, group in _grouped(batches, 1 << 14):
            fps = np.frombuffer(b"".join(whole.column("wide").to_pylist()), np.uint64).reshape(-1, WORDS)
            u, v = _near_sets(whole, group, fps, wide_gate, least)
            node = whole.column(4).to_numpy()
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    kinds = "bucket long, lo int, hi int, side int, node long, size long, exact boolean"
    left = map_arrow(_dealt(met, "size", "exact", "fp"), first, kinds)
    left = left.join(_merged(prints), "node")
    return map_arrow(_dealt(left.select(*keys, "wide"), "size", "exact", "wide"), second, "u long, v long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (but the last) that cut no group of the first ``keys`` columns.

    The rows must come sorted by those columns.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            same &= column == column[-1]
        end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if end:
            yield table.slice(0, end)
        held = table.slice(end).to_batches()
        count = table.num_rows - end
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document by links of ``radius`` bits or fewer.

    Equal fingerprints are one node, so copies cost nothing.  Null or empty text has fingerprint
    zero and is linked like any other.  Repeated rows give repeated rows.  A null doc_id keeps its
    row and has the component of its fingerprint; ids of a component are never null unless all are.
    An empty table gives an empty result.
    """
    signed = settle(fingerprints(docs, words))
    nodes = settle(signed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rows = nodes.select(
        F.explode(block_keys(F.col("fp"), radius)).alias("bucket"), F.col("fp").alias("node"), "fp"
    )
    return _with_components(signed, nodes, links(rows, radius)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _with_components(signed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges).withColumnRenamed("node", "fp")
    linked = nodes.join(found, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    by = linked.join(least, "component").select("fp", "least")
    ids = nodes.join(by, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return signed.join(settle(ids), "fp")  # a join by itself, which can split the copies of a hot fingerprint


_WIDEN = np.array([1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set in WORDS words; the first is :func:`fingerprint`."""
    out = []
    for k in range(WORDS):
        h = hashes * _WIDEN[k]
        out.append(fingerprint(h ^ (h >> np.uint64(32)) if k else h))
    return np.array(out, np.int64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, same, size, wide, own) of every text: ``key`` a hash of the text, ``size`` the number of distinct
    hashes of its shingles, ``same`` a hash of them all, ``wide`` their fingerprint, ``own`` their upper halves in order."""
    names = ["doc_id", "key", "same", "size", "wide", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                same, size, fp, kept = [], [], [], []
                for text in some.column(2):
                    own = np.unique(shingle_hashes(text.as_py(), words))
                    same.append(np.uint64(xxh64_intdigest(own.tobytes())).astype(np.int64))
                    size.append(len(own))
                    fp.append(wide_print(own).tobytes())
                    kept.append((own >> np.uint64(32)).astype(np.uint32).tobytes())
                columns = [some.column(0), some.column(1), pa.array(same, pa.int64()), pa.array(size, pa.int64())]
                columns += [pa.array(fp, pa.binary()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(_keyed(docs), run, "doc_id long, key long, same long, size long, wide binary, own binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets of a binary column, where each set starts)."""
    raw = column.to_pylist()
    starts = np.cumsum([0, *(len(x) // 4 for x in raw)])
    return np.frombuffer(b"".join(raw), np.uint32), starts


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, counts): the shingles that most sets hold, FREQUENT at most, sorted by hash.

    Tasks count COUNTED shingles at a time, over all sets, and leave out what is there less than OFTEN times; so a
    shingle that is not given has fewer sets than that for each such count, or is rarer than all that are given.
    Counts only decide in which order shingles are looked at; no result depends on them.  Where to stop is read from how
    many shingles have each count (those of one count in 16 slices by hash), so no task sends its own best to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_flat(batch.column(0))[0])
            if sum(map(len, held)) >= COUNTED:
                yield _often(np.concatenate(held), OFTEN)
                held = []
        if held:
            yield _often(np.concatenate(held), OFTEN)

    counts = settle(map_arrow(sets.select("own"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    counts = counts.withColumn("rank", F.struct(-F.col("n"), F.shiftright("h", 28)))
    held = counts.groupBy("rank").agg(F.count("*").alias("held"))
    held = held.withColumn("held", F.sum("held").over(Window.orderBy("rank")))
    last = held.where(F.col("held") <= FREQUENT).agg(F.max("rank").alias("last"))
    top = counts.join(F.broadcast(last), F.col("rank") <= F.col("last")).select("h", "n").toPandas()
    forget(sets.sparkSession, counts)
    h = top["h"].to_numpy(np.int64).astype(np.uint32)
    order = np.argsort(h)
    return h[order], top["n"].to_numpy(np.int64)[order]


def _often(h: np.ndarray, least: int) -> pa.RecordBatch:
    h, n = np.unique(h, return_counts=True)
    many = n >= least
    return pa.RecordBatch.from_arrays([pa.array(h[many].astype(np.int64)), pa.array(n[many])], ["h", "n"])


def prefix(own: np.ndarray, count: np.ndarray, least: float) -> np.ndarray:
    """Places in ``own`` of the first shingles of a set, the rarest first: any two sets of similarity ``least`` or
    more have one of them in common, since the others are too few to make up for all of these.

    ``own`` may be parts of hashes, and repeat: the smallest value that two sets have in common is still there.
    """
    n = len(own)
    k = n - int(np.ceil(least * n - 1e-9)) + 1
    rare = np.flatnonzero(count == 0)
    if len(rare) >= k:
        return rare[:k]
    rest = np.flatnonzero(count)
    return np.concatenate([rare, rest[np.argsort(count[rest], kind="stable")][: k - len(rare)]])


def _buckets(sets: DataFrame, shared, least: float, piece: int) -> DataFrame:
    """(bucket, cuts, node, fp, size, exact): every set in the buckets of its first shingles; ``cuts`` is more than 1
    where more than ``piece`` sets may hold the shingle.  Small sets have buckets of their own, those near the
    limit are in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = shared.value
        for batch in batches:
            own, starts = _flat(batch.column(3))
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
            count = np.where(h[at] == own, n[at], 0) if len(h) else np.zeros(len(own), np.int64)
            size = np.diff(starts)
            fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, WORDS)[:, 0]
            taken = [prefix(own[a:b], count[a:b], least) + a for a, b in zip(starts[:-1], starts[1:], strict=True)]
            row = np.repeat(np.arange(len(size)), [len(t) for t in taken])
            taken = np.concatenate(taken)
            for exact, here in ((True, size[row] * least < SMALL), (False, size[row] >= SMALL)):
                r, t = row[here], taken[here]
                bucket = 2 * own[t].astype(np.int64) + exact
                columns = [pa.array(bucket), pa.array(np.maximum(1, -(-count[t] // piece)).astype(np.int32))]
                columns += [batch.column(0).take(pa.array(r)), pa.array(fp[r]), batch.column(2).take(pa.array(r)), pa.array(np.full(len(r), exact))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "cuts", "node", "fp", "size", "exact"])

    rows = sets.select("same", "wide", "size", "own")
    return map_arrow(rows, run, "bucket long, cuts int, node long, fp long, size long, exact boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def alike(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all sets of similarity ``least`` or more: a forest, found by counting what is common."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(at, kind="stable")]
    count = np.bincount(at)
    start = np.cumsum(count) - count
    waiting = np.ones(n, bool)
    u, v = [], []
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue and waiting.any():
            i = queue.pop()
            own = at[first[i] : first[i + 1]]
            many = count[own]
            where = np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            common = np.bincount(holders[where], minlength=n)
            new = np.flatnonzero(waiting & (common >= least * (sizes + sizes[i] - common)))
            waiting[new] = False
            queue += new.tolist()
            u += [i] * len(new)
            v += new.tolist()
    return np.array(u, np.int64), np.array(v, np.int64)


def _exact_links(rows: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """(u, v) that connect the nodes of each (cluster, lo, hi) whose whole sets are alike.

    ``rows`` name a node's text by doc_id and key; of ``texts`` (doc_id, key, text) only these are read on.
    """
    keys = ["cluster", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, 3, 1):
            cols = [whole.column(k).to_numpy() for k in range(4)]
            change = np.zeros(len(cols[0]) - 1, bool)
            for c in cols[:3]:
                change |= c[1:] != c[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(cols[0])]
            for a, b in zip(edges, edges[1:], strict=False):
                node, first = np.unique(cols[3][a:b], return_index=True)
                some = whole.column(4).slice(a, b - a)
                u, v = alike([np.unique(shingle_hashes(some[int(i)].as_py(), words)) for i in first], least)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    met = texts.join(bounded(settle(rows.select(*keys, "node", "doc_id", "key").distinct()), SENT), ["doc_id", "key"])
    met = met.select(*keys, "node", "text").repartition(parts(rows.sparkSession), *keys)
    return map_arrow(met.sortWithinPartitions(*keys, "node"), run, "u long, v long")


def _merged(side: DataFrame) -> DataFrame:
    """``side`` of a join by shuffling and merging.  These tables grow with the corpus, and the driver, which makes a
    broadcast, would hold one after another where they are still short."""
    return side.hint("merge")


def _cut(held: DataFrame, by: str, weight: Column, most: int, name: str) -> DataFrame:
    """``held`` with ``name``, which of the cuts of its group ``by`` a node is in, and ``name``s, how many there are."""
    cuts = held.groupBy(by).agg(F.ceil(F.sum(weight) / most).cast("int").alias(f"{name}s"))
    return held.join(_merged(cuts), by).withColumn(name, F.pmod(F.xxhash64("node"), F.col(f"{name}s")).cast("int"))


def _every(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def _apart(held: DataFrame, by: str, labels: DataFrame, weight: Column, most: int) -> DataFrame:
    """(by, lo, hi, side, node, ...): the stragglers of each group against all of it, in cuts.

    A group's stragglers are the nodes that ``labels`` (node, component) do not join to its largest component.
    A group all in one component has none and goes.
    """
    held = held.join(_merged(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = held.groupBy(by, "component").agg(F.sum(weight).alias("w")).groupBy(by).agg(
        F.max_by("component", F.struct("w", "component")).alias("main"), F.count("*").alias("n")
    ).where("n > 1")
    held = held.join(_merged(main.drop("n")), by)
    few = _cut(held.where("component <> main"), by, weight, most, "few")
    many = _cut(held, by, weight, most, "many")
    sides = few.select(by, "fews").distinct(), many.select(by, "manys").distinct()
    one = few.join(_merged(sides[1]), by).withColumn("hi", _every("manys")).withColumn("lo", F.col("few")).withColumn("side", F.lit(1))
    two = many.join(_merged(sides[0]), by).withColumn("lo", _every("fews")).withColumn("hi", F.col("many")).withColumn("side", F.lit(2))
    return one.unionByName(two, allowMissingColumns=True)


def _labels(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("node").agg(F.min("component").alias("component"))


def near_copies(
    docs: DataFrame, words: int = 5, least: float = 0.8, gate: int = GATE, wide_gate: int = WIDE_GATE, piece: int = PIECE
) -> DataFrame:
    """(doc_id, key, component_id, component_key) where texts are linked by a similarity of ``least`` or more.

    Similarity is that of the sets of ``words``-word shingles (two empty sets are equal); ``key`` is a hash of
    the text, and a component is named by its smallest (doc_id, key).  Equal sets are one node.  Sets that can
    be so similar share a bucket (:func:`prefix`); there, fingerprints of the sets are compared bit-sliced, and
    those more than ``gate`` bits apart of 64, or ``wide_gate`` of the wider ones, are rejected (64 and 256
    reject none).  What is left makes clusters, in
    which whole sets are compared.  Rows with a null doc_id take no part.

    Of a bucket or cluster that is too large for a task, cuts are linked first, and then only what this did
    not join to the largest component is compared with everything, so a large group of copies costs
    little more than its size; what stays apart costs its number times the group's size.
    """
    spark = docs.sparkSession
    named = docs.where("doc_id is not null")
    made = shingle_sets(named, words).withColumn("row", F.monotonically_increasing_id())
    every = settle(made)
    nodes = settle(every.groupBy("same").agg(
        F.min(F.struct("doc_id", "key", "row")).alias("first"), F.first("size").alias("size")
    ).select("same", "first.doc_id", "first.key", "first.row", "size"))
    sets = settle(every.join(_merged(nodes.where("size > 0").select("same", "row")), ["same", "row"]).select("same", "size", "wide", "own"))
    signed = settle(every.select("doc_id", "key", "same"))
    forget(spark, every)
    known = frequent(sets)
    shared = spark.sparkContext.broadcast(known)
    rows = _buckets(sets, shared, least, piece)
    texts = _keyed(named)
    cut = F.pmod(F.xxhash64("node", "bucket"), F.col("cuts")).cast("int")
    prints = settle(sets.select(F.col("same").alias("node"), "wide"))
    near = near_sets(rows.withColumns({"lo": cut, "hi": cut, "side": F.lit(0)}), prints, gate, wide_gate, least)
    edges = _verified(_clusters(near, nodes), texts, words, least)
    if len(known[1]) and int(known[1].max()) > piece:
        edges = settle(edges)
        labels = settle(_labels(edges))
        large = settle(rows.where("cuts > 1").drop("cuts"))
        near = near_sets(_apart(large, "bucket", labels, F.lit(1), piece), prints, gate, wide_gate, least)
        edges = edges.unionByName(_verified(_clusters(near, nodes), texts, words, least, labels))
    found = _labels(edges).withColumnRenamed("node", "same")
    linked = nodes.join(_merged(found), "same")
    by = linked.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    ids = linked.join(_merged(by), "component").select("same", "least")
    own = F.coalesce("least", F.struct("doc_id", "key"))
    ids = nodes.join(_merged(ids), "same", "left").select("same", own.alias("least"))
    return signed.select("doc_id", "key", "same").join(_merged(settle(ids)), "same").select(
        "doc_id", "key", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("component_key")
    )


def _clusters(near: DataFrame, nodes: DataFrame) -> DataFrame:
    found = _labels(near).withColumnRenamed("component", "cluster")
    return found.join(_merged(nodes.select(F.col("same").alias("node"), "size", "doc_id", "key")), "node")


def _verified(held: DataFrame, texts: DataFrame, words: int, least: float, labels: DataFrame | None = None) -> DataFrame:
    """(u, v) that connect the nodes of each cluster of (node, cluster, size, doc_id, key) that are alike by their whole sets.

    A cluster of more than CLUSTER shingles is cut, and stragglers are compared with all of it.  With
    ``labels`` (node, component) known, only what these leave apart is compared.
    """
    held = settle(_cut(held, "cluster", F.col("size"), CLUSTER, "own"))
    if labels is None:
        within = held.withColumns({"lo": F.col("own"), "hi": F.lit(-1)})
        edges = settle(_exact_links(within, texts, words, least))
        large = held.where("owns > 1")
        if large.isEmpty():
            return edges
        labels = settle(_labels(edges))
    else:
        edges, large = None, held
    apart = _apart(large.select("cluster", "node", "size", "doc_id", "key"), "cluster", labels, F.col("size"), CLUSTER)
    more = _exact_links(apart, texts, words, least)
    return more if edges is None else edges.unionByName(more)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of :func:`near_copies`: that of the smallest doc_id and, where a
    doc_id has several texts, the smallest hash of the text.

    Rows that repeat a kept doc_id and text stay once.  Rows with a null doc_id stay as they are.  An
    empty table gives none.  Columns of any name stay.
    """
    found = near_copies(docs, **options)
    ids = ["_kept_id", "_kept_key"]
    fate = settle(found.groupBy(F.col("doc_id").alias(ids[0]), F.col("key").alias(ids[1])).agg(
        F.bool_or((F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("component_key"))).alias("stays"),
        F.count("*").alias("rows"),
    ))
    kept, gone = fate.where("stays"), fate.where("not stays")
    few, many, most = fate.agg(F.count_if(~F.col("stays")), F.count_if("stays"), F.max(F.when(F.col("stays"), F.col("rows")))).first()
    named = docs.withColumns({ids[0]: F.col("doc_id").cast("long"), ids[1]: F.xxhash64(text_of(docs))}).where(F.col(ids[0]).isNotNull())
    if few <= many:  # the shorter list goes to all tasks
        named = named.join(bounded(gone.select(ids), SENT), ids, "left_anti")
    else:
        named = named.join(bounded(kept.select(ids), SENT), ids, "left_semi")
    if (most or 0) > 1:
        named = named.dropDuplicates(ids)
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
