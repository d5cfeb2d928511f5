"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the vocabulary's pattern; every distinct piece is merged once and remembered.  For
a piece, the leaves of a segment tree hold the rank of the pair that starts at each live byte
position (infinity where there is none) and each inner node the leftmost minimum below it.  The
root names the next merge; a merge changes three leaves and the nodes above them.  Pieces of similar
length are merged together, one numpy row each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of

#: Entries of one generation of remembered pieces; two generations are kept.
REMEMBERED = 300_000
_NONE = np.int64(2**62)


class Vocabulary:
    """Ranks of a byte-level BPE file (base64 bytes and rank a line) and the pattern that cuts text."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {str(rank): piece for piece, rank in self.ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.first = np.full(256, -1, np.int64)
        for piece, rank in self.ranks.items():
            if len(piece) == 1:
                self.first[piece[0]] = rank
        self.width = max(self.ranks.values(), default=0) + 1
        keys, values = [], []
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                left, right = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    values.append(rank)
        order = np.argsort(keys, kind="stable")
        self.pair_keys = np.array([*np.array(keys, np.int64)[order], _NONE], np.int64)
        self.pair_ranks = np.array([*np.array(values, np.int64)[order], -1], np.int64)
        self._young: dict[str, str] = {}
        self._old: dict[str, str] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a negative number where the two don't merge."""
        key = left * self.width + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece; all of at most one power of two of bytes."""
        n, span = len(pieces), 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.zeros((n, span), np.uint8)
        raw[np.arange(span) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(np.arange(span) < lengths[:, None], self.first[raw], -1)
        after = np.minimum(np.arange(span) + 1, span)[None, :].repeat(n, 0)
        before = np.arange(-1, span - 1)[None, :].repeat(n, 0)
        tree = np.full((n, 2 * span), _NONE)
        rank = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, span - 1)
        # a node holds rank * span + position, so that a minimum is the leftmost of its rank
        tree[:, span:-1] = np.where(rank >= 0, rank * span + np.arange(span - 1), _NONE)
        for node in range(span - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        ids = np.concatenate([ids, np.full((n, 1), -1)], 1)  # a place after the end
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            best = tree[live, 1]
            at, new = best % span, best // span
            gone = after[live, at]
            follow = after[live, gone]
            ids[live, at], ids[live, gone] = new, -1
            after[live, at] = follow
            inner = follow < span
            before[live[inner], follow[inner]] = at[inner]
            prior = before[live, at]
            self._set(tree, live, gone, np.full(len(live), -1), span)
            self._set(tree, live, at, self.pair(new, ids[live, follow]), span)
            led = prior >= 0
            some, left = live[led], prior[led]
            self._set(tree, some, left, self.pair(ids[some, left], new[led]), span)
            live = live[tree[live, 1] < _NONE]
        ids = ids[:, :-1]
        kept = ids >= 0
        ends = np.cumsum(kept.sum(1))
        flat = ids[kept].tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _set(tree, rows, position, rank, span) -> None:
        """Point update: the leaf of ``position`` in each row, then the nodes above it."""
        node = position + span
        tree[rows, node] = np.where(rank >= 0, rank * span + position, _NONE)
        while len(node) and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _learn(self, pieces: Iterable[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            known = self.ranks.get(raw)
            if known is not None:
                self._young[piece] = str(known)
            else:
                groups.setdefault(max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for bits, group in groups.items():
            step = max(1, (1 << 19) >> bits)
            for i in range(0, len(group), step):
                some = group[i : i + step]
                for (piece, _), ids in zip(some, self.merge([raw for _, raw in some]), strict=True):
                    self._young[piece] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimal numbers joined by commas.

        Pieces that are not remembered are merged together; give about a million characters at once.
        """
        cut = list(map(self.cut, texts))
        if len(self._young) > REMEMBERED:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        missing = set().union(*cut).difference(young)
        young.update((p, old[p]) for p in missing.intersection(old))
        self._learn(p for p in missing if p not in young)
        return [",".join(map(young.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: str) -> bytes:
        """The bytes of ids joined by commas."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary a worker process; the file must be at ``path`` on every executor."""
    return Vocabulary(path, pattern)


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(path, pattern) of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _chunks(lengths: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, count) of runs of texts that hold about ``most`` characters, or one longer text."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(lengths) > start:
        yield start, len(lengths) - start


def _mapped(docs: DataFrame, path: str, pattern: str, row, fields: str, keep: list[str]) -> DataFrame:
    """Runs ``row`` (vocabulary, a text's ids) over all texts; ``keep`` columns pass unchanged."""
    names = [x.split()[0] for x in fields.split(", ")]
    source = docs.select(*keep, text_of(docs).alias("_bpe_text"))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema] + [fields]
    )
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    out_types = [kinds[x.split()[1]] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            vocab = vocabulary(path, pattern)
            sizes = pa.compute.binary_length(whole.column(len(keep))).to_pylist()
            for start, count in _chunks(sizes):
                some = whole.slice(start, count)
                rows = [row(vocab, ids) for ids in vocab.encode(some.column(len(keep)).to_pylist())]
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), out_types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(i) for i in range(len(keep))), *made], [*keep, *names]
                )

    return map_arrow(source, run, schema)


def encode_digest(docs: DataFrame, path: str, pattern: str, keep=("doc_id",)) -> DataFrame:
    """Per document: ``keep``, n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again).

    Null text is empty: no tokens, and the digests of nothing.  Repeated rows give repeated rows;
    an empty table gives none.  Other columns, whatever their names, are left behind.
    """

    def row(vocab: Vocabulary, ids: str) -> tuple:
        return (
            ids.count(",") + 1 if ids else 0,
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(vocab.decode(ids)).hexdigest(),
        )

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, path, pattern, row, fields, list(keep))


def encode(docs: DataFrame, path: str, pattern: str, keep=("doc_id",)) -> DataFrame:
    """Per document: ``keep``, n_tokens and token_ids, little-endian unsigned 32-bit numbers."""

    def row(vocab: Vocabulary, ids: str) -> tuple:
        packed = np.array(ids.split(",") if ids else [], dtype="<u4")
        return len(packed), packed.tobytes()

    return _mapped(docs, path, pattern, row, "n_tokens long, token_ids binary", list(keep))


def decode(encoded: DataFrame, path: str, pattern: str, column: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded_text``: the ids of ``column`` as text again (null stays null)."""

    @F.pandas_udf("string")
    def text(ids):
        vocab = vocabulary(path, pattern)

        def one(packed):
            if packed is None:
                return None
            numbers = np.frombuffer(packed, "<u4").tolist()
            return vocab.decode(",".join(map(str, numbers))).decode("utf-8", "replace")

        return ids.map(one)

    return encoded.withColumn("decoded_text", text(F.col(column)))
