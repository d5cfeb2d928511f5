import numpy as np
import pytest

from trailmark.llm import training_order as order


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    f = order.Feistel(n, 7)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (f.number(slots) == np.arange(n)).all()
    if n >= 64:
        assert (slots != order.Feistel(n, 8).slot(np.arange(n))).any()


def packed(*ids):
    return np.array(ids, "<u2").tobytes()


def written(spark, tokens, tmp_path, length, per_shard, name="out"):
    made = order.ordered(tokens, length=length)
    order.write_shards(made, str(tmp_path / name), length, per_shard)
    return made, str(tmp_path / name)


def test_shards_hold_every_token_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 60000, n).tolist() for n in rng.integers(0, 60, 150)]
    rows = [(d, packed(*ids)) for d, ids in enumerate(lists)] + [(None, packed(1, 2)), (5, packed(9)), (5, packed(9)), (6, None)]
    rows.append((7, packed(10, 2570, 13, 3338, 0)))  # bytes that end lines
    tokens = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, token_ids binary, slot int").repartition(3)
    made, path = written(spark, tokens, tmp_path, 10, 16)
    shards = {r.shard: bytes(r.content) for r in order.read_shards(spark, path).collect()}
    got, at = {}, 0
    for s in order.index(made, 16).orderBy("shard").collect():
        content = shards.pop(s.shard)
        assert s.first_slot == at == s.shard * 16 and len(content) == s.n * order.stride(10) == s.n * 25
        at += s.n
        for d, part, ids in zip(s.doc_ids, s.parts, order.records(content, 10), strict=True):
            got.setdefault((d, part), []).append(ids)
    assert not shards
    want = {}
    for d, ids in rows:
        ids = np.frombuffer(ids or b"", "<u2").tolist()
        for i in range(0, len(ids), 10):
            want.setdefault((d, i // 10), []).append(ids[i : i + 10])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_slots_do_not_depend_on_partitions(spark):
    """Against numbers counted one after another, in 2, 3 and 7 partitions and other orders of rows."""
    rng = np.random.default_rng(2)
    rows = [(int(d) - 50, packed(*rng.integers(0, 60000, rng.integers(0, 40)).tolist())) for d in rng.permutation(200)]
    rows += [(None, packed(7, 8, 9))] * 3
    numbered, at = {}, 0
    for d, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for part in range(-(-len(ids) // 16)):
            numbered.setdefault((d, part), []).append(at)
            at += 1
    f = order.Feistel(at, order.KEY)
    want = sorted(((k, int(f.slot(np.array([n]))[0])) for k, v in numbered.items() for n in v), key=repr)
    for n in (2, 3, 7):
        some = [rows[i] for i in np.random.default_rng(n).permutation(len(rows))]
        tokens = spark.createDataFrame(some, "doc_id long, token_ids binary").repartition(n)
        got = [((r.doc_id, r.part), r.slot) for r in order.ordered(tokens, length=8).collect()]
        assert sorted(got, key=repr) == want


def test_write_and_resume(spark, tmp_path):
    """Reading on from a slot by its byte; a whole write is not done again, and of a broken one only what broke."""
    tokens = spark.createDataFrame([(d, packed(*range(d, d + 30))) for d in range(40)], "doc_id long, token_ids binary")
    made, path = written(spark, tokens, tmp_path, 10, 8)
    every = [ids for r in order.read_shards(spark, path).orderBy("shard").collect() for ids in order.records(bytes(r.content), 10)]
    by_slot = {r.slot: np.frombuffer(r.ids, "<u2").tolist() for r in made.collect()}
    assert every == [by_slot[i] for i in range(120)]
    rest = [r for r in order.read_shards(spark, path, 37, 8).orderBy("shard").collect()]
    assert [r.shard for r in rest] == list(range(4, 15))
    files = {int(f.parent.name[6:]): f for f in (tmp_path / "out").glob("wave=*/shard=*/part*")}
    for slot in (0, 37, 119):
        with open(files[slot // 8], "rb") as f:
            f.seek(slot % 8 * order.stride(10))
            assert order.records(f.read(order.stride(10)), 10) == [by_slot[slot]]
    stamp = files[3].stat().st_mtime_ns
    order.write_shards(made, path, 10, 8)
    assert files[3].stat().st_mtime_ns == stamp
    (files[3].parent.parent / "_SUCCESS").unlink()
    files[3].write_bytes(b"broken")
    other = files[0].stat().st_mtime_ns
    order.write_shards(made, path, 10, 8)
    again = [ids for r in order.read_shards(spark, path).orderBy("shard").collect() for ids in order.records(bytes(r.content), 10)]
    assert again == every and files[0].stat().st_mtime_ns == other  # waves that were whole stay


def test_empty_table(spark):
    from trailmark.llm import bpe

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert order.materialise(docs, *bpe.public_vocabulary()).count() == 0
    assert order.ordered(spark.createDataFrame([], "doc_id long, token_ids binary")).count() == 0


def test_documents(spark):
    """The query's columns, from what was written."""
    import hashlib

    from trailmark.llm import bpe

    docs = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "é" * 3000, "z"), (None, "abc", "x")], "doc_id long, text string, part string")
    got = order.materialise(docs, *bpe.public_vocabulary()).collect()
    assert len(got) == 1 and got[0].n == len(got[0].doc_ids) and set(got[0].doc_ids) == {1, 3, None}
    made = order.ordered_documents(docs, *bpe.public_vocabulary()).orderBy("slot").collect()
    content = b"".join((len(r.ids) // 2).to_bytes(4) + bytes(r.ids).ljust(1024, b"\xff") + b"\n" for r in made)
    assert got[0].payload_sha256 == hashlib.sha256(content).hexdigest() and got[0].n_bytes == len(content)


def test_tokenised(spark):
    from trailmark.llm import bpe

    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "é" * 300)], "doc_id long, text string")
    path = bpe.public_vocabulary()
    got = {r.doc_id: np.frombuffer(r.token_ids, "<u2").tolist() for r in order.tokenised(docs, *path).collect()}
    own = {r.doc_id: np.frombuffer(r.token_ids, "<u4").tolist() for r in bpe.encode(docs, *path).collect()}
    assert got == own
