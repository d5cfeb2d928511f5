"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over a corpus.

A text is cut at single spaces between solid characters, where neither tokenizer makes a token across; what lies
between two cuts is a chunk, and every chunk that a task meets for the first time is tokenised and aligned, all
new ones of a batch together: token lengths are summed to ends (cumsum), ends that both have are the cuts of
groups (intersect1d), tokens find their group (searchsorted), and repeats expand every group to its links.
Documents are sums over their chunks.

A block of documents is one row, with the links of its documents as CSR arrays and their number of documents a
link; those numbers are added in two stages, salted first.  Links in more documents than a bound allows many
of are looked up in arrays that every task holds, the others by a shuffled join.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, parts, settle, settle_blocks

#: Links whose number of documents every task holds: those in more documents than all links' sum divided by this,
#: so no more links than this.
HELD = 1 << 20
#: Partial sums of one link are dealt to so many keys first.
SALT = 16
#: Chunks that a task remembers at most, and bytes of them, their groups and links; it then starts anew.
REMEMBERED, REMEMBERED_BYTES = 200_000, 1 << 26
#: Pairs expanded at once; links of a block's documents, after which it ends.
EXPANDED, BLOCK = 1 << 22, 1 << 18
#: Characters whose chunks are counted at once; a longer text is cut at a safe space behind so many.
AT_ONCE = 1 << 18

_BLOCK = (
    "doc array<{}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "indptr array<int>, link array<int>, times array<long>, pair array<long>, docs array<long>"
)


def public_tokenizers_paths(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[str, str]:
    """Paths of two installed public vocabulary files: a byte-level one and one of pieces."""
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others
    in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """A byte-level tokenizer and one of pieces, and what they make of the chunks met so far."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        alphabet = _byte_level()
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in alphabet for c in token)
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.long_a, self.long_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.width = len(pieces)
        self.span = len(self.bytes_a) * self.width
        #: Whether chunks can be told apart: no piece goes on behind a space.
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.starts = regex.compile(r"[\p{L}\p{N}!-~]").match
        self.ends = regex.compile(r"[\p{L}\p{N}\p{M}!-~]").match
        self.safe = regex.compile(r"(?<=[\p{L}\p{N}\p{M}!-~]) (?=[\p{L}\p{N}!-~])").search
        #: An id as text with what follows it in a list of groups.
        self.said = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"] + [f"{i}{mark}" for i in range(self.width) for mark in (",", ";", "")]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}  # of a chunk, its place in all that follows; its last places hold nothing yet
        self.loose: set[str] = set()  # words that must not stand alone
        self.texts: list[str | None] = []  # groups of a chunk, None where the bytes differ
        self.numbers = np.empty((1024, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.upto = np.zeros(1025, np.int64)  # where a chunk's links end, by its place + 1
        self.links, self.times = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.bytes = 0  # about what chunks, groups and links take

    def full(self) -> bool:
        """Whether it is time to forget: many chunks, or long ones, as texts without spaces are."""
        return len(self.index) > REMEMBERED or self.bytes > REMEMBERED_BYTES

    def parts(self, text: str) -> Iterator[str]:
        """``text`` cut at safe spaces behind every AT_ONCE characters."""
        start = 0
        while self.apart and len(text) - start > AT_ONCE and (cut := self.safe(text, start + AT_ONCE)):
            yield text[start : cut.start()]
            start = cut.end()
        yield text[start:] if start else text

    def chunks(self, texts: list[str]) -> list[list[str]]:
        """Each text cut at its safe spaces, which go; a chunk stands for itself with a space before it."""
        if not self.apart:
            return [[t] for t in texts]
        cut = [t.split(" ") for t in texts]
        index, loose = self.index, self.loose
        loose.update(w for w in set().union(*cut).difference(index) if not (self._starts(w) and self._ends(w)))
        return [words if loose.isdisjoint(words) else self._joined(words) for words in cut]

    def _starts(self, word: str) -> bool:
        return "!" <= word[:1] <= "~" or self.starts(word) is not None

    def _ends(self, word: str) -> bool:
        return "!" <= word[-1:] <= "~" or self.ends(word[-1:]) is not None

    def _joined(self, words: list[str]) -> list[str]:
        out: list[list[str]] = []
        closed = False  # whether a chunk may begin here
        for w in words:
            if not out or (closed and self._starts(w)):
                out.append([w])
            else:
                out[-1].append(w)
            closed = self._ends(w)
        return [" ".join(x) for x in out]

    def learn(self, chunks: set[str]) -> None:
        """Tokenises and aligns the chunks that are not remembered, AT_ONCE characters together."""
        left = list(chunks.difference(self.index))
        start = held = 0
        for i, c in enumerate(left):
            if held > AT_ONCE:
                self._learn(left[start:i])
                start, held = i, 0
            held += len(c)
        self._learn(left[start:])

    def _learn(self, chunks: list[str]) -> None:
        if not chunks:
            return
        sizes = np.array([len(c.encode()) + 1 for c in chunks], np.int64)
        solid = self.apart and all(self._starts(c) and self._ends(c) for c in chunks)
        made = None
        ids_b = self.b.encode(chunks, num_threads=1)
        if solid:  # many as one text: where they meet nothing reaches across
            rows = [" " + " ".join(chunks[i : i + 256]) for i in range(0, len(chunks), 256)]
            a = [i for e in self.a.encode_batch_fast(rows, add_special_tokens=False) for i in e.ids]
            b = [i for ids in ids_b for i in ids]
            want = "".join(rows).encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want:
                made = self._aligned(np.array(a, np.int64), np.array(b, np.int64), np.cumsum(sizes)), [True] * len(chunks)
        if made is None:  # one by one, and those whose bytes differ have no tokens
            ids_a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
            same = []
            for c, x, y in zip(chunks, ids_a, ids_b, strict=True):
                want = b" " + c.encode()
                same.append(b"".join(map(self.bytes_a.__getitem__, x)) == want and b"".join(map(self.bytes_b.__getitem__, y)) == want)
            kept = [[i for ids, ok in zip(all_ids, same, strict=True) if ok for i in ids] for all_ids in (ids_a, ids_b)]
            made = self._aligned(*(np.array(x, np.int64) for x in kept), np.cumsum(np.where(same, sizes, 0))), same
        (numbers, texts, n, links, times), same = made
        start = len(self.texts)
        end, at = start + len(chunks), int(self.upto[start])
        self.numbers, self.upto = _room(self.numbers, end), _room(self.upto, end + 1)
        self.links, self.times = _room(self.links, at + len(links)), _room(self.times, at + len(links))
        self.numbers[start:end] = numbers
        self.upto[start + 1 : end + 1] = at + np.cumsum(n)
        self.links[at : at + len(links)], self.times[at : at + len(links)] = links, times
        self.texts += [t if ok else None for t, ok in zip(texts, same, strict=True)]
        self.index.update(zip(chunks, range(start, end), strict=True))
        self.bytes += int(sizes.sum()) + sum(map(len, texts)) + 16 * len(links)

    def _aligned(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple:
        """Numbers, groups text, number of links, and links with their times, of each chunk; ``ends`` are the chunks' last
        bytes.

        All chunks are one sequence: where a chunk ends both end, so groups never cross chunks.
        """
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        many_a, many_b = np.bincount(in_a, minlength=len(cuts)), np.bincount(in_b, minlength=len(cuts))
        upto = [np.searchsorted(x, ends, "right") for x in (end_a, end_b, cuts)]
        n_a, n_b, n_groups = (np.diff(x, prepend=0) for x in upto)
        whose = np.repeat(np.arange(len(ends)), n_a)  # the chunk of each A token
        n_links = np.bincount(whose, many_b[in_a], len(ends)).astype(np.int64)
        key, times = self._links(a, in_a, whose, b, many_b)
        sizes = np.bincount(key // self.span, minlength=len(ends))
        texts = self._texts(a, b, in_a, in_b, many_a, many_b, upto)
        return np.stack([n_a, n_b, n_groups, n_links], 1), texts, sizes, key % self.span, times

    def _texts(self, a, b, in_a, in_b, many_a, many_b, upto) -> list[str]:
        """``a1,a2|b1;a3|b2`` of every chunk: tokens in the order of group, side and place, each with what follows it."""
        last_a, last_b = (np.diff(x, append=-1) != 0 for x in (in_a, in_b))  # the last of its group
        closing = np.zeros(len(b), bool)
        closing[upto[1][upto[1] > 0] - 1] = True  # the last of its chunk
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[in_a]] = 2 * a + last_a
        order[np.arange(len(b)) + np.cumsum(many_a)[in_b]] = 2 * len(self.bytes_a) + 3 * b + last_b + closing
        words = list(map(self.said.__getitem__, order.tolist()))
        edges = (upto[0] + upto[1]).tolist()
        return ["".join(words[x:y]) for x, y in zip([0, *edges[:-1]], edges, strict=True)]

    def _links(self, a, group, whose, b, many_b) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (chunk, A id, B id) as one number, and their occurrences: every A token with all B tokens of its
        group.  EXPANDED pairs are expanded at once; a token with more of them takes its B tokens by distinct id."""
        first_b = np.cumsum(many_b) - many_b
        base = whose * self.span + a * self.width
        counts = many_b[group]
        upto = np.concatenate([[0], np.cumsum(counts)])
        keys, times = [], []
        start = 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(upto, upto[start] + EXPANDED, "right")) - 1)
            n = counts[start:stop]
            if n[0] > EXPANDED:
                first = int(first_b[group[start]])
                other, each = np.unique(b[first : first + int(n[0])], return_counts=True)
                keys.append(base[start] + other)
                times.append(each)
            else:
                within = np.arange(int(n.sum())) - np.repeat(upto[start:stop] - upto[start], n)
                other = b[np.repeat(first_b[group[start:stop]], n) + within]
                key, each = np.unique(np.repeat(base[start:stop], n) + other, return_counts=True)
                keys.append(key)
                times.append(each)
            start = stop
        return _summed(keys, times)


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """``held`` with room for ``n`` rows."""
    if len(held) >= n:
        return held
    out = np.zeros((max(n, 2 * len(held)), *held.shape[1:]), held.dtype)
    out[: len(held)] = held
    return out


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times."""
    if len(keys) == 1:
        return keys[0], times[0]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _grouped(np.concatenate(keys), np.concatenate(times))


def _grouped(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    return key[new], np.add.reduceat(times[order], new) if len(new) else times[:0]


@lru_cache(maxsize=1)
def pair(a: str, b: str) -> Pair:
    """One pair a worker process; the files must be at their paths on every executor."""
    return Pair(a, b)


class Block:
    """The documents of one block, gathered: parts of texts wait until they have AT_ONCE characters together."""

    def __init__(self, made: Pair):
        self.made, self.shas, self.whole, self.begun = made, [], [], []
        self.waiting: list[tuple[int, str]] = []
        self.held = self.size = 0
        self.numbers: list[tuple[np.ndarray, np.ndarray]] = []  # (document, its numbers so far)
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.again = False  # whether a document is in more than one of them

    def add(self, text: str | None) -> None:
        doc = len(self.shas)
        self.shas.append(hashlib.sha256())
        self.whole.append(bool(text))
        self.begun.append(False)
        for i, part in enumerate(self.made.parts(text) if text else ()):
            self.again |= i > 0
            self.waiting.append((doc, part))
            self.held += len(part)
            if self.held >= AT_ONCE:
                self.count()

    def count(self) -> None:
        """Aligns what is waiting: documents are sums over their distinct chunks."""
        if not self.waiting:
            return
        made = self.made
        if made.full():
            made.forget()
        cut = made.chunks([part for _, part in self.waiting])
        made.learn(set().union(*cut))
        place = [list(map(made.index.__getitem__, c)) for c in cut]
        for (doc, _), at in zip(self.waiting, place, strict=True):
            texts = list(map(made.texts.__getitem__, at))
            if None in texts:
                self.whole[doc] = False
            elif self.whole[doc]:
                self.shas[doc].update((";" * self.begun[doc] + ";".join(texts)).encode())
                self.begun[doc] = True
        n = len(made.texts)
        docs = np.repeat(np.array([d for d, _ in self.waiting], np.int64), [len(x) for x in place])
        key, often = np.unique(docs * n + np.array([i for at in place for i in at], np.int64), return_counts=True)
        doc, at = key // n, key % n
        edges = np.flatnonzero(np.diff(doc, prepend=-1))
        self.numbers.append((doc[edges], np.add.reduceat(made.numbers[at] * often[:, None], edges)))
        size = made.upto[at + 1] - made.upto[at]
        flat = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(made.upto[at], size)
        key, times = _grouped(np.repeat(doc, size) * made.span + made.links[flat], made.times[flat] * np.repeat(often, size))
        self.keys.append(key)
        self.times.append(times)
        self.size += len(key)
        self.waiting, self.held = [], 0

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        def one(values, kind=None) -> pa.Array:
            values = values if isinstance(values, pa.Array) else pa.array(values, kind)
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        self.count()
        n, span = len(self.shas), self.made.span
        whole = np.array(self.whole, bool)
        numbers = np.zeros((n, 4), np.int64)
        for docs, some in self.numbers:
            numbers[docs] += some
        numbers[~whole] = 0
        key, times = np.concatenate([np.empty(0, np.int64), *self.keys]), np.concatenate([np.empty(0, np.int64), *self.times])
        if self.again:
            key, times = _grouped(key, times)
        kept = whole[key // span]
        key, times = key[kept], times[kept]
        known, place, docs = np.unique(key % span, return_inverse=True, return_counts=True)
        indptr = np.searchsorted(key, np.arange(n + 1) * span)
        shas = [s.hexdigest() if ok else "" for s, ok in zip(self.shas, self.whole, strict=True)]
        cols = [one(numbers[:, k], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays(
            [one(ids), *cols, one(shas, pa.string()), one(indptr, pa.int32()), one(place, pa.int32()),
             one(times, pa.int64()), one(known, pa.int64()), one(docs, pa.int64())],
            ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "indptr", "link", "times", "pair", "docs"],
        )


def blocks(docs: DataFrame, a: str, b: str, by: str = "doc_id") -> DataFrame:
    """Blocks of aligned documents: their numbers, and their links as CSR arrays over the distinct ``pair`` of the block
    (A id * pieces + B id), with ``docs``, in how many of its documents each is."""
    rows = docs.select(F.col(by), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pair(a, b)
        for batch in batches:
            block, start = Block(made), 0
            for i, text in enumerate(batch.column(1)):
                block.add(text.as_py())
                if block.size > BLOCK:
                    yield block.batch(batch.column(0).slice(start, i + 1 - start))
                    block, start = Block(made), i + 1
            if block.shas:
                yield block.batch(batch.column(0).slice(start))

    return map_arrow(rows, run, _BLOCK.format(rows.schema[0].dataType.simpleString()))


def link_counts(made: DataFrame, salt: int = SALT) -> DataFrame:
    """(pair, n): in how many documents each link is.  Partial sums of a link go to ``salt`` keys, then to one."""
    dealt = made.select(F.explode(F.arrays_zip("pair", "docs")).alias("p"), F.pmod(F.spark_partition_id(), F.lit(salt)).alias("salt"))
    first = dealt.groupBy(F.col("p.pair").alias("pair"), "salt").agg(F.sum("p.docs").alias("n"))
    return first.groupBy("pair").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    Texts that are null or empty, or that the tokens of ``a`` or ``b`` do not give back byte by byte, have no
    tokens: zeros and an empty digest.  Repeated rows are documents of their own, each with a row.  A null doc_id
    stays null.  Of links that are an A id's most frequent, ties all count.  An empty table gives no rows.
    Other columns, whatever their names, are left behind.
    """
    made = settle_blocks(blocks(docs, a, b))
    return with_counts(made, settle(link_counts(made)), pair(a, b).width)


def with_counts(made: DataFrame, counts: DataFrame, width: int, held: int = HELD) -> DataFrame:
    """The documents of ``made`` blocks with what the ``counts`` of their links add up to.

    ``width``: pieces of the B vocabulary.  Counts above (sum of all) / ``held``, which at most ``held`` links have,
    are broadcast as arrays; links below are joined by shuffling, spread by link.
    """
    spark = made.sparkSession
    id_a = F.floor(F.col("pair") / width)
    best = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("most"))
    told = counts.join(best, id_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = settle(told)
    total = told.agg(F.sum("n")).first()[0] or 0
    above = told.where(F.col("n") > F.lit(total) / held).toArrow()  # at most ``held`` rows of three numbers
    order = np.argsort(above["pair"].to_numpy(), kind="stable")
    hot = spark.sparkContext.broadcast(tuple(above[c].to_numpy()[order] for c in ("pair", "n", "best")))
    kind = made.schema["doc"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pairs, ns, bests = hot.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(batch.num_rows):
                cols = {name: batch.column(k)[i].values for k, name in enumerate(batch.schema.names)}
                asked = cols["pair"].to_numpy()
                at = np.minimum(np.searchsorted(pairs, asked), max(0, len(pairs) - 1))
                known = pairs[at] == asked if len(pairs) else np.zeros(len(asked), bool)
                n = np.where(known, ns[at] if len(pairs) else 0, 0)
                top = known & (bests[at] if len(pairs) else False)
                link, times, ptr = (cols[c].to_numpy() for c in ("link", "times", "indptr"))
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ptr]) for x in (times * top[link], times * n[link])]
                cold = ~known[link]
                upto = np.concatenate([[0], np.cumsum(cold)])[ptr].astype(np.int32)
                size = len(cols["doc"])
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x[cold], pa.int64())) for x in (asked[link], times)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + size)), cols["doc"], cols["n_a"], cols["n_b"], cols["n_groups"], cols["n_links"],
                     cols["groups_sha256"], pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), *lists],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "cold", "cold_times"],
                )
                row += size

    schema = (
        f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, "
        "cold array<long>, cold_times array<long>"
    )
    rows = settle(map_arrow(made.drop("docs"), run, schema), compression="zstd")
    asked = rows.where(F.size("cold") > 0).select("row", F.explode(F.arrays_zip("cold", "cold_times")).alias("c"))
    asked = asked.select("row", F.col("c.cold").alias("pair"), F.col("c.cold_times").alias("times"))
    rare = told.where(F.col("n") <= F.lit(total) / held)
    added = asked.join(rare, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_count")
    )
    out = rows.drop("cold", "cold_times").join(added, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
