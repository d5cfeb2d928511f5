"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is embedded by two hashes, of the whole word and of its first bytes, so that forms of a word
that were never labelled still share a row.  Filters of several widths slide over the embedded words, each
filter keeps its largest answer in the whole text (max pooling), and a logistic layer makes a score
from 0 to 1.  After training, embedding and filters are multiplied out once, so that scoring a word
is a few table rows added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, forget, map_arrow, parts, settle, text_of

#: Rows of the embedding for whole words, and as many again for their first PREFIX bytes.
BUCKETS = 1 << 15
PREFIX = 4
NOTHING = 2 * BUCKETS
#: Labelled rows and bytes of a shard, about: what one task learns from at a time.  All rows are in some shard.
SHARD, SHARD_BYTES = 4096, 32 << 20
#: Passes over all shards after the first shard has made a start; words that a training step looks at together.
ROUNDS, STEP_WORDS = 3, 1 << 16
#: Embedding rows that are averaged together, and groups that a block's sums are first added up in.
BLOCK, LANES = 4096, 16
WIDTHS = (1, 2, 3)
DIM, FILTERS = 16, 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def word_ids(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(two embedding rows of every word, number of words of every text) of UTF-8 ``data``.

    ``starts`` cuts the data: it holds the first byte of each text and the end.  A word is a run of ASCII letters,
    digits and non-ASCII bytes, ASCII letters lower-cased.
    """
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    prior = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    first = np.flatnonzero(inside & (~prior | edge[:-1]))
    counts = np.diff(np.searchsorted(first, starts))
    if not len(first):
        return np.zeros((0, 2), np.int64), counts
    last = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    values = _LOWER[data]
    place = np.zeros(len(data), np.int64)
    place[first[0] :] = np.arange(first[0], len(data)) - np.repeat(
        first, np.diff(np.append(first, len(data)))
    )
    place *= inside
    power = _powers(int(place.max()) + 1)
    values = np.where(inside, (values + np.uint64(1)) * power[place], np.uint64(0))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    ids = np.empty((len(first), 2), np.int64)
    for k, end in enumerate((last, np.minimum(first + PREFIX, last))):
        mixed = (total[end] - total[first]) * _MIX
        mixed ^= mixed >> np.uint64(32)
        ids[:, k] = (mixed * _BASE) >> np.uint64(49)
    ids[:, 1] += BUCKETS
    return ids, counts


def _powers(n: int) -> np.ndarray:
    size = max(1024, 1 << (n - 1).bit_length())
    return _power_table(size)


@lru_cache(maxsize=4)
def _power_table(size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)


@dataclass
class Classifier:
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    weights: np.ndarray
    bias: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def table(self) -> np.ndarray:
        """For each embedding row: what it adds to each filter in each place; last row: no word."""
        columns = [place for by in self.filters for place in by]
        return np.vstack([self.embedding @ np.hstack(columns), np.zeros((1, FILTERS * len(columns)))]).astype(np.float32)


def pooled(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Largest answer of every filter in each text, at least 0; a text without words gives zeros."""
    out = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
    some = counts > 0
    if not len(ids):
        return out
    begin = (np.cumsum(counts) - counts)[some]
    for w, answer in enumerate(_answers(table, ids, begin + counts[some] - 1)):
        top = np.maximum.reduceat(answer, begin)
        out[some, w * FILTERS : (w + 1) * FILTERS] = np.maximum(top, 0)
    return out


def _answers(table: np.ndarray, ids: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """By width: the filters' answers to the words from each word on; ``last`` words of texts have nothing behind them."""
    adds = table[ids[:, 0]]
    adds += table[ids[:, 1]]
    column = 0
    for width in WIDTHS:
        answer = adds[:, column : column + FILTERS].copy()
        for place in range(1, width):
            part = adds[place:, column + place * FILTERS : column + (place + 1) * FILTERS].copy()
            for back in range(place):  # words whose place-th follower is beyond the text
                over = last - back
                part[over[(over >= 0) & (over < len(part))]] = 0
            answer[:-place] += part
        column += width * FILTERS
        yield answer


def pooled_long(table: np.ndarray, raw: np.ndarray, window: int) -> np.ndarray:
    """:func:`pooled` of one text, about ``window`` bytes of whole words at a time: a maximum of maxima.

    The last words of a window, whose filters reach into the next, are answered with that.
    """
    out = np.zeros(FILTERS * len(WIDTHS), np.float32)
    ahead = max(WIDTHS) - 1
    held, start = np.zeros((0, 2), np.int64), 0
    while start < len(raw) or len(held):
        end = _word_end(raw, min(start + window, len(raw)), window)
        ids = np.concatenate([held, word_ids(raw[start:end], np.array([0, end - start]))[0]]) if end > start else held
        n = len(ids) if end == len(raw) else max(0, len(ids) - ahead)
        if n:
            for w, answer in enumerate(_answers(table, ids, np.array([len(ids) - 1]))):
                span = slice(w * FILTERS, (w + 1) * FILTERS)
                out[span] = np.maximum(out[span], answer[:n].max(0))
        held, start = ids[n:], end
    return out


def _word_end(raw: np.ndarray, at: int, step: int) -> int:
    """The first place from ``at`` on that is in no word, or the end."""
    while at < len(raw):
        gaps = np.flatnonzero(~_WORD[raw[at : at + step]])
        if len(gaps):
            return at + int(gaps[0])
        at += step
    return len(raw)


def _after(ids: np.ndarray, owner: np.ndarray, at: np.ndarray, place: int) -> np.ndarray:
    """The words ``place`` places after those ``at``, in the same text (NOTHING beyond its end)."""
    to = np.minimum(at + place, len(ids) - 1)
    out = ids[to]
    out[(to != at + place) | (owner[to] != owner[at])] = NOTHING
    return out


def text_ids(raw: np.ndarray, window: int = 1 << 16) -> np.ndarray:
    """:func:`word_ids` of one text, about ``window`` bytes of whole words at a time."""
    out, start = [np.zeros((0, 2), np.int32)], 0
    while start < len(raw):
        end = _word_end(raw, min(start + window, len(raw)), window)
        out.append(word_ids(raw[start:end], np.array([0, end - start]))[0].astype(np.int32))
        start = end
    return np.concatenate(out)


def _constant(toxic: bool) -> Classifier:
    """A model that scores all alike."""
    filters = [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS]
    return Classifier(np.zeros((NOTHING, DIM), np.float32), filters, np.zeros(FILTERS * len(WIDTHS), np.float32), 4.0 if toxic else -4.0)


def train(
    texts: list[str | bytes], labels: np.ndarray, epochs: int | None = None, seed: int = 7,
    start: Classifier | None = None, rate: float | None = None,
) -> Classifier:
    """Fits the classifier by Adam on small batches; every whole text is used.

    Goes on from ``start`` where there is one.  ``rate``, how many of all rows are toxic, is that of these unless given.
    """
    rows = [text_ids(np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)) for text in texts]
    return train_words(rows, labels, epochs, seed, start, rate)


def train_words(
    rows: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, seed: int = 7,
    start: Classifier | None = None, rate: float | None = None,
) -> Classifier:
    """:func:`train` of texts that are :func:`text_ids` already."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    if rate is None:
        if not n or len(set(labels.tolist())) < 2:
            return _constant(bool(n and labels.all()))
        rate = float(labels.mean())
    if start is None:
        model = Classifier(
            rng.normal(0, 0.1, (NOTHING, DIM)).astype(np.float32),
            [rng.normal(0, 0.5 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
            float(np.log(rate / (1 - rate))),
        )
    else:
        model = Classifier(start.embedding.copy(), [f.copy() for f in start.filters], start.weights.copy(), start.bias)
    params = [model.embedding, *model.filters, model.weights]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    bias_moment = [0.0, 0.0]
    step, size = 0, 32
    if epochs is None:
        epochs = min(40, max(6, -(-1500 // max(1, n // size))) if n < 4000 else 6)
    weight = np.where(labels == 1, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, size):
            batch = order[i : i + size]
            counts = np.array([len(rows[b]) for b in batch])
            ids = np.concatenate([rows[b] for b in batch])
            if not len(ids):
                continue
            ids[rng.random(len(ids)) < 0.5, 0] = NOTHING  # so that first bytes are learnt as well
            step += 1
            _step(model, params, moment, bias_moment, ids, counts, labels[batch], weight[batch], step)
    return model


def _step(model, params, moment, bias_moment, ids, counts, labels, weight, step) -> None:
    embedding = np.vstack([model.embedding, np.zeros((1, DIM), np.float32)])
    begin = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    pool = np.full((len(counts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    where = np.zeros(pool.shape, np.int64)
    for lo in range(0, len(ids), STEP_WORDS):  # a long text in pieces: a maximum of maxima
        hi = min(lo + STEP_WORDS, len(ids))
        words = []
        for place in range(max(WIDTHS)):
            word = _after(ids, owner, np.arange(lo, hi), place)
            words.append(embedding[word[:, 0]] + embedding[word[:, 1]])
        for w, by in enumerate(model.filters):
            answer = words[0] @ by[0]
            for place in range(1, len(by)):
                answer += words[place] @ by[place]
            span = slice(w * FILTERS, (w + 1) * FILTERS)
            for row in range(owner[lo], owner[hi - 1] + 1):
                a, b = max(begin[row], lo), min(begin[row] + counts[row], hi)
                if a >= b:
                    continue
                best = answer[a - lo : b - lo].argmax(0) + a
                top = answer[best - lo, np.arange(FILTERS)]
                better = top > pool[row, span]
                where[row, span] = np.where(better, best, where[row, span])
                pool[row, span] = np.maximum(pool[row, span], top)
    live = pool > 0
    pool = np.where(live, pool, np.float32(0))
    score = 1 / (1 + np.exp(-np.clip(pool @ model.weights + model.bias, -30, 30)))
    error = ((score - labels) * weight / len(labels)).astype(np.float32)
    grads = [np.zeros_like(p) for p in params[1:]]
    grads[-1] = pool.T @ error
    back = error[:, None] * model.weights[None, :] * live
    touched, moved = [], []
    for w, by in enumerate(model.filters):
        span = slice(w * FILTERS, (w + 1) * FILTERS)
        at, g = where[:, span], back[:, span]
        for place in range(len(by)):
            word = _after(ids, owner, at, place)
            grads[w][place] = np.einsum("nfd,nf->df", embedding[word].sum(2), g)
            down = (g[:, :, None] * by[place].T[None]).reshape(-1, DIM)
            for k in (0, 1):
                touched.append(word[:, :, k].ravel())
                moved.append(down)
    touched, moved = np.concatenate(touched), np.concatenate(moved)
    real = touched < NOTHING
    rows, inverse = np.unique(touched[real], return_inverse=True)
    by_row = np.zeros((len(rows), DIM), np.float32)
    np.add.at(by_row, inverse, moved[real])
    lr, b1, b2 = 0.01, 0.9, 0.99
    m, v = moment[0]
    m[rows] = b1 * m[rows] + (1 - b1) * by_row
    v[rows] = b2 * v[rows] + (1 - b2) * by_row**2
    model.embedding[rows] -= lr * m[rows] / (np.sqrt(v[rows]) + 1e-6)
    for p, g, (m, v) in zip(params[1:], grads, moment[1:], strict=True):
        m += (1 - b1) * (g - m)
        v += (1 - b2) * (g**2 - v)
        p -= lr * (m / (1 - b1**step)) / (np.sqrt(v / (1 - b2**step)) + 1e-8)
    g = float(error.sum())
    bias_moment[0] = b1 * bias_moment[0] + (1 - b1) * g
    bias_moment[1] = b2 * bias_moment[1] + (1 - b2) * g * g
    model.bias -= lr * (bias_moment[0] / (1 - b1**step)) / (np.sqrt(bias_moment[1] / (1 - b2**step)) + 1e-8)


class Scorer:
    """A trained classifier with its multiplied-out tables, made once a process."""

    def __init__(self, model: Classifier):
        self.table, self.weights, self.bias = model.table(), model.weights, model.bias

    def __call__(self, data: np.ndarray, starts: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Scores of the UTF-8 texts cut at ``starts``, about ``most`` bytes of whole texts at a time, longer texts alone and
        in windows: the memory does not depend on their length."""
        out, i, n = [], 0, len(starts) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
            part = data[starts[i] : starts[j]]
            if len(part) > 2 * most:
                pool = pooled_long(self.table, part, most)[None]
            else:
                pool = pooled(self.table, *word_ids(part, starts[i : j + 1] - starts[i]))
            z = pool @ self.weights + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
            i = j
        return np.concatenate(out) if out else np.zeros(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of an Arrow string or binary column without nulls, not copied."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32 of doc_id as text, modulo 5, is 0 (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, shard: int = SHARD, shard_bytes: int = SHARD_BYTES, rounds: int = ROUNDS) -> Classifier:
    """Trains on all labelled documents outside the held-out fold.

    Rows are dealt to shards by a hash.  The first shard makes a start; then, ``rounds`` times, every shard goes on from
    the model so far in a task of its own, once through its texts, and what the shards changed is averaged.  Only the
    model (a few MB whatever the input) comes to the driver, and reruns over the same partitions agree.  Rows with a null doc_id
    or label teach nothing; a doc_id labelled both ways is toxic; each text of a doc_id teaches once.  Nothing to learn
    from gives a model that scores all alike.  About every tenth row sets thresholds instead of weights: for
    each language, as its labels say, the score that best separates the two.
    """
    spark = docs.sparkSession
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = settle(known)
    texts = docs.select("doc_id", "lang", text_of(docs).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    taught = texts.join(bounded(known), "doc_id").withColumn("hash", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "hash"])
    taught = settle(taught)
    forget(spark, known)
    teach, tune = taught.where("pmod(hash, 10) <> 0"), taught.where("pmod(hash, 10) = 0")
    n, toxic, size = teach.agg(F.count("*"), F.sum("toxic"), F.sum(F.octet_length("text"))).first()
    if not n or toxic in (0, n):
        model = _constant(bool(n and toxic == n))
    else:
        shards = max(-(-n // shard), -(-size // shard_bytes))
        dealt = teach.select(F.pmod(F.expr("hash div 10"), F.lit(shards)).alias("shard"), "doc_id", "hash", "toxic", "text")
        model = _pass(dealt.where("shard = 0"), None, toxic / n, None)
        for k in range(rounds if shards > 1 else 0):
            model = _pass(dealt, model, toxic / n, 1, k + 1)
    _calibrate(model, tune)
    forget(spark, taught)
    return model


def _pass(dealt: DataFrame, start: Classifier | None, rate: float, epochs: int | None, number: int = 0) -> Classifier:
    """The mean of what each shard of (shard, doc_id, hash, toxic, text) makes of ``start``: of an embedding row over the
    shards that changed it, of all else over the rows."""
    spark = dealt.sparkSession
    shared = spark.sparkContext.broadcast(start)
    rows = dealt.repartition(parts(spark), "shard").sortWithinPartitions("shard", "doc_id", "hash")
    names = ["block", "lane", "shard", "total", "n"]
    schema = "block int, lane int, shard long, total binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total, n, rest, held = None, 0, 0, 0, 0
        begun = shared.value
        for shard, words, labels in _shards(batches):
            model = train_words(words, labels, epochs, 7 + 1000 * number + shard, begun, rate)
            first = shard if first is None else first
            change = model.embedding.astype(np.float64)
            if begun is not None:
                change -= begun.embedding
                n = n + (change != 0).any(1).astype(np.float64)
            else:
                n = n + np.ones(len(change))
            total = total + change
            rest = rest + len(words) * np.concatenate([*(f.ravel() for f in model.filters), model.weights, [model.bias]]).astype(np.float64)
            held += len(words)
        if first is not None:
            out = [(at // BLOCK, total[at : at + BLOCK], n[at : at + BLOCK]) for at in range(0, NOTHING, BLOCK)]
            for block, x, k in [*out, (-1, rest, np.array([float(held)]))]:
                yield pa.RecordBatch.from_pylist([dict(zip(names, (block, first % LANES, first, x.tobytes(), k.tobytes()), strict=True))], _SUMS)

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("shard").to_numpy())
        total, n = (sum(np.frombuffer(group.column(c)[int(i)].as_py(), np.float64) for i in order) for c in ("total", "n"))
        row = {c: group.column(c)[int(order[0])].as_py() for c in names[:3]} | {"total": total.tobytes(), "n": n.tobytes()}
        return pa.Table.from_pylist([row], _SUMS)

    sums = map_arrow(rows, run, schema).groupBy("block", "lane").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    sums = settle(sums)  # with that, the shuffled texts go
    by = {r["block"]: (np.frombuffer(r["total"], np.float64), np.frombuffer(r["n"], np.float64)) for r in sums.toArrow().to_pylist()}  # a model
    forget(spark, sums)
    shared.unpersist()
    rest, held = by.pop(-1)
    rest = (rest / held).astype(np.float32)
    mean = np.concatenate([x.reshape(-1, DIM) / np.maximum(n, 1)[:, None] for _, (x, n) in sorted(by.items())])
    cuts = np.cumsum([w * DIM * FILTERS for w in WIDTHS])
    filters = [f.reshape(w, DIM, FILTERS) for w, f in zip(WIDTHS, np.split(rest, cuts)[:-1], strict=True)]
    if start is not None:
        mean = start.embedding + mean
    return Classifier(mean.astype(np.float32), filters, rest[cuts[-1] : -1], float(rest[-1]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(shard, words of its texts, labels) of rows sorted by shard; texts are held a batch at a time, as they come."""
    at, words, labels = None, [], []
    for batch in batches:
        data, starts = utf8(batch.column("text"))
        for i, (shard, toxic) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("toxic").to_pylist(), strict=True)):
            if shard != at and words:
                yield at, words, np.array(labels, np.int64)
                words, labels = [], []
            at = shard
            words.append(text_ids(data[starts[i] : starts[i + 1]]))
            labels.append(toxic)
    if words:
        yield at, words, np.array(labels, np.int64)


_SUMS = pa.schema([("block", pa.int32()), ("lane", pa.int32()), ("shard", pa.int64()), ("total", pa.binary()), ("n", pa.binary())])


def _calibrate(model: Classifier, tune: DataFrame) -> None:
    """For each language: the threshold in 0.2 .. 0.8 with the fewest errors, nearest 0.5 on ties."""
    model.thresholds = {None: 0.5}
    grid = np.round(np.arange(0.2, 0.81, 0.05), 2)
    scored = score(tune.where("lang is not null"), model, keep=("lang", "toxic"))
    wrong = [F.count_if((F.col("score") >= float(t)) != (F.col("toxic") == 1)).alias(f"e{k}") for k, t in enumerate(grid)]
    for lang, *errors in scored.groupBy("lang").agg(*wrong).collect():  # a row a language
        model.thresholds[lang] = float(min(zip(errors, np.abs(grid - 0.5), grid, strict=True))[2])


def score(docs: DataFrame, model: Classifier, keep=("doc_id",)) -> DataFrame:
    """Per document: ``keep``, score.  Only the text enters a score; null text is empty.

    Repeated rows have equal scores each; an empty table gives none.  The model (a few MB whatever the input) is
    broadcast.  A task holds one whole text, and arrays for a window of it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, text_of(docs).alias("_tox_text"))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema]
        + ["score double"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer(*utf8(batch.column(len(keep))))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*keep, "score"])

    return map_arrow(source, run, schema)


def classify(docs: DataFrame, model: Classifier, keep=("doc_id", "lang")) -> DataFrame:
    """:func:`score` plus ``predicted`` (score >= 0.5) and ``toxic_in_lang`` (the language's own
    threshold, 0.5 where a language is null or was not seen; a score at the threshold is toxic)."""
    scored = score(docs, model, keep)
    cut = F.lit(0.5)
    for lang, threshold in model.thresholds.items():
        if lang is not None:
            cut = F.when(F.col("lang") == lang, F.lit(threshold)).otherwise(cut)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn(
        "toxic_in_lang", F.col("score") >= cut
    )


def drop_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` without the documents that the threshold of their language rejects; all columns as they
    were, whatever their names.  Null and empty texts are scored like any other; an empty table gives none."""
    names = [f"_keep{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], "lang", "text")
    kept = classify(rows, model, keep=(*names, "lang")).where("not toxic_in_lang")
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
