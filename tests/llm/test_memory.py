import os
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from trailmark.llm import alignment, common, resampling, toxicity
from trailmark.llm.common import map_arrow


def test_a_worker_gives_memory_back(spark):
    def held() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    def run(batches):
        for batch in batches:
            small = [np.ones(60_000, np.uint8) for _ in range(5_000)]
            sys.pinned = np.ones(60_000, np.uint8)  # stays above them, so that the allocator alone gives nothing back
            top = held()
            del small
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([top])], ["pid", "mb"])

    def after(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([held()])], ["pid", "mb"])

    one = spark.range(1).coalesce(1)
    [(pid, top)] = map_arrow(one, run, "pid long, mb long").collect()
    again = {r.pid: r.mb for _ in range(8) for r in map_arrow(one, after, "pid long, mb long").collect()}
    assert pid in again, "the worker was not used again"
    assert again[pid] < top - 200


def test_shards_are_cut_across_batches():
    rows = [(0, "a b", 1), (0, "c", 0), (0, "", 0), (2, "a", 1), (5, "b a", 0)]
    whole = pa.RecordBatch.from_pylist([dict(zip(("shard", "text", "toxic"), r, strict=True)) for r in rows])
    for size in (1, 2, 3, 5):
        batches = [whole.slice(i, size) for i in range(0, len(rows), size)]
        found = list(toxicity._shards(iter(batches)))
        assert [(s, [len(w) for w in words], labels.tolist()) for s, words, labels in found] == [(0, [2, 1, 0], [1, 0, 0]), (2, [1], [1]), (5, [2], [0])]


@pytest.mark.parametrize("taken, collected", [(40, 0), (50, 0), (51, 1), (100, 1)])
def test_a_driver_whose_heap_is_over_half_collects_its_garbage(taken, collected):
    done = []
    heap = SimpleNamespace(totalMemory=lambda: taken, maxMemory=lambda: 100)
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=lambda: done.append(1)))
    common.collect_garbage(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))))
    assert len(done) == collected


def test_every_settled_table_sees_to_the_drivers_garbage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "collect_garbage", seen.append)
    assert common.settle(spark.range(3)).count() == 3
    assert len(seen) == 1


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    yield
    spark.conf.set(name, before)


def block_tables(spark, since):
    """(rows, row groups) of the files of each table of blocks that was settled after the first ``since``."""
    out = []
    for at in common._ours[spark.sparkContext.applicationId][since:]:
        held = ds.dataset(at.removeprefix("file://"), format="parquet")
        if "indptr" in held.schema.names:
            out.append([(f.metadata.num_rows, f.metadata.num_row_groups) for f in held.get_fragments() if f.metadata.num_rows])
    return out


def test_a_task_holds_one_block_of_features(spark, small_batches):
    """A task with many blocks writes and reads them one by one."""
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('w', id, ' x') AS text").coalesce(1)
    since = common.written(spark)
    assert resampling.resampled(docs, docs.select("text")).count() == 50
    assert block_tables(spark, since) == [[(5, 5)]]


def test_a_task_holds_one_block_of_links(spark, small_batches):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('w', id, ' x') AS text").coalesce(1)
    since = common.written(spark)
    assert alignment.aligned(docs, *alignment.public_tokenizers_paths()).count() == 50
    assert block_tables(spark, since) == [[(5, 5)]]


def test_long_chunks_are_forgotten(monkeypatch):
    """Texts without a space are single chunks: few of them, however long, fill what a worker remembers."""
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 100_000, raising=False)
    monkeypatch.setattr(alignment, "AT_ONCE", 1 << 12)
    made = alignment.Pair(*alignment.public_tokenizers_paths())
    block = alignment.Block(made)
    for i in range(100):
        block.add("".join(f"x{(i * 1_000 + k) ** 3}" for k in range(500)))
    block.count()
    assert sum(map(len, made.index)) + sum(len(t) for t in made.texts if t) < 400_000
