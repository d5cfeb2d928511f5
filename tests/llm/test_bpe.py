import hashlib
import random

import pytest
import tiktoken

from trailmark.llm import bpe

PATH, PATTERN = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library():
    ranks = bpe.vocabulary(PATH, PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(1)
    parts = ["a", "b", "th", "e", "in", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "!", "日", "\U0001f600", "​", "x" * 9]
    out = ["", " ", "aaaa" * 50, "x" * 3000, "\x1c\x1f\x85 a", "<|endoftext|>", "qz" * 9000, " \t\n " * 9]
    return out + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(80))) for _ in range(1500)]


def test_ids_are_the_librarys(library):
    vocab = bpe.Vocabulary(PATH, PATTERN)
    for some in (texts(), texts()[::-1]):
        for text, ids in zip(some, vocab.encode(some), strict=True):
            assert ids == ",".join(map(str, library.encode_ordinary(text)))
            assert vocab.decode(ids) == text.encode()


def test_forgetting_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    vocab = bpe.Vocabulary(PATH, PATTERN)
    for text in texts():
        assert vocab.encode([text]) == [",".join(map(str, library.encode_ordinary(text)))]


def test_digest(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (None, "Hello  world", "c"), (3, "é" * 500, None), (3, "é" * 500, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, _bpe_text string, n_tokens int")
    got = sorted(map(tuple, bpe.encode_digest(docs, PATH, PATTERN).collect()), key=repr)
    want = []
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode_digest(docs.limit(0), PATH, PATTERN).count() == 0


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coded = bpe.decode(bpe.encode(docs, PATH, PATTERN, keep=("doc_id", "text")), PATH, PATTERN)
    assert coded.where("decoded_text <> text or octet_length(token_ids) <> 4 * n_tokens").count() == 0
    assert coded.count() == docs.count()
