import zlib

import numpy as np
from pyspark.sql import functions as F

from trailmark.llm import toxicity


def test_word_ids():
    raw = [x.encode() for x in ("Hello, World hello", "", "  ", "ÀB c1", "hello")]
    starts = np.cumsum([0, *map(len, raw)])
    ids, counts = toxicity.word_ids(np.frombuffer(b"".join(raw), np.uint8), starts)
    assert counts.tolist() == [3, 0, 0, 2, 1]
    assert (ids[0] == ids[2]).all() and (ids[0] == ids[5]).all() and (ids[0] != ids[1]).any()


def test_pooling_stays_inside_a_text():
    rng = np.random.default_rng(0)
    model = toxicity.train(["good text", "bad words"] * 8, np.array([0, 1] * 8))
    counts = rng.integers(0, 5, 40)
    ids = np.stack([rng.integers(0, toxicity.BUCKETS, counts.sum()), rng.integers(toxicity.BUCKETS, toxicity.NOTHING, counts.sum())], 1)
    table = model.table()
    together = toxicity.pooled(table, ids, counts)
    at = 0
    for k, n in enumerate(counts):
        own = ids[at : at + n]
        want = []
        for width, by in zip(toxicity.WIDTHS, model.filters, strict=True):
            words = [model.embedding[a] + model.embedding[b] for a, b in own]
            answers = [sum(words[i + j] @ by[j] for j in range(width) if i + j < n) for i in range(n)]
            want.append(np.maximum(np.max(answers, axis=0), 0) if n else np.zeros(toxicity.FILTERS))
        assert np.allclose(together[k], np.concatenate(want), atol=1e-4)
        at += n


def invented(spark, n=1500):
    rng = np.random.default_rng(5)
    plain = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]
    rows, labels = [], []
    for d in range(n):
        words = [plain[i] for i in rng.integers(0, 400, rng.integers(3, 60))]
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * 2):
            words.insert(int(rng.integers(0, len(words))), f"nasty{rng.integers(0, 300)}")
        rows.append((d, " ".join(words), "en" if d % 2 else "fr"))
        labels.append((d, 1, toxic))
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = invented(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.classify(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    n, right, by_lang = scored.agg(
        F.count("*"), F.sum((F.col("predicted") == F.col("toxic")).cast("int")),
        F.sum((F.col("toxic_in_lang") == (F.col("toxic") == 1)).cast("int")),
    ).first()
    assert n > 200 and right >= 0.95 * n and by_lang >= 0.95 * n
    assert set(model.thresholds) == {None, "en", "fr"}


def test_held_out_is_crc32(spark):
    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    for r in docs.withColumn("h", toxicity.held_out(F.col("doc_id"))).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_score_ignores_all_but_the_text(spark):
    docs, labels = invented(spark, 300)
    model = toxicity.fit(docs, labels)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1000)
    a = [r.score for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert a == [r.score for r in toxicity.score(other, model).orderBy("doc_id").collect()]


def test_edge_rows(spark):
    docs, labels = invented(spark, 300)
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None), (9999, 1, 1)], labels.schema)))
    rows = [(1, None, "en"), (1, None, "en"), (2, "", None), (None, "word " * 30000, "xx"), (3, "!!! ...", "en")]
    got = toxicity.classify(spark.createDataFrame(rows, docs.schema), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id is not None}) == 1
    assert toxicity.classify(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.classify(docs, toxicity.fit(docs, few)).where("predicted = 1").count() == 0


def test_drop_keeps_columns_of_any_name(spark):
    docs, labels = invented(spark, 300)
    model = toxicity.fit(docs, labels)
    more = docs.select("*", F.lit(1).alias("score"), F.lit("x").alias("predicted"), F.lit(None).cast("string").alias("_keep0"))
    out = toxicity.drop_toxic(more.unionByName(more.where("doc_id = 0").withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})), model)
    assert out.columns == more.columns and 0 < out.count() < 301
    assert toxicity.drop_toxic(more.where("false"), model).count() == 0


def test_long_texts_in_windows():
    """The same scores whatever the window, and no more memory for a text of 30 MB than for its bytes and a window."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = [b"some", b"words", "\u00e9t\u00e9".encode(), b"x" * 300, b"bad", b"3"]
    table = rng.normal(0, 1, (toxicity.NOTHING + 1, toxicity.FILTERS * sum(toxicity.WIDTHS))).astype(np.float32)
    table[-1] = 0
    for n in (0, 1, 2, 3, 50, 400):
        raw = np.frombuffer(b" , ".join(words[i] for i in rng.integers(0, len(words), n)), np.uint8)
        want = toxicity.pooled(table, *toxicity.word_ids(raw, np.array([0, len(raw)])))[0]
        for window in (1, 7, 64, 10_000):
            assert np.array_equal(toxicity.pooled_long(table, raw, window), want), (n, window)
    scorer = toxicity.Scorer(toxicity.train([], np.zeros(0, np.int64)))
    raw = np.frombuffer(b"several common words in a row and more " * 800_000, np.uint8)
    tracemalloc.start()
    assert len(scorer(raw, np.array([0, len(raw)]))) == 1
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()


def test_every_labelled_row_teaches(spark):
    """What only one row in thousands says is learnt, wherever it is, and so is what stands in a very long text."""
    plain = [f"word{chr(97 + i % 26)}{i}" for i in range(300)]
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for d in range(6000):
        words = [plain[i] for i in rng.integers(0, 300, 12)]
        toxic = int(d % 10 == 0)
        if toxic:
            words.insert(3, f"zq{d // 10 % 40:02}vile")  # a marker is in 15 rows or so
        rows.append((d, " ".join(words), "en"))
        labels.append((d, 1, toxic))
    for d in range(6000, 6060):  # a word that stands in long texts only
        rows.append((d, " ".join([*plain] * 80) + " kwdreadful", "en"))
        labels.append((d, 1, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert min(len(t) for _, t, _ in rows[6000:]) > 1 << 17
    model = toxicity.fit(docs, known, shard=1500)
    asked = [(k, f"{plain[k]} {plain[k + 1]} zq{k:02}vile {plain[k + 2]}", "en") for k in range(40)]
    asked += [(100, f"{plain[5]} kwdreadful {plain[6]}", "en")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(asked, docs.schema), model).collect()}
    assert sum(s >= 0.5 for k, s in got.items() if k < 40) >= 38
    assert got[100] >= 0.5
    again = toxicity.fit(docs, known, shard=1500)
    assert np.array_equal(model.embedding, again.embedding) and model.bias == again.bias


def test_step_in_pieces(monkeypatch):
    """A training step gives the same whatever the number of words looked at together."""
    texts = ["some plain text here", "", "bad words here and more of them", "x"] * 8
    labels = np.array([0, 0, 1, 0] * 8)
    whole = toxicity.train(texts, labels, epochs=2)
    monkeypatch.setattr(toxicity, "STEP_WORDS", 3)
    cut = toxicity.train(texts, labels, epochs=2)
    assert np.allclose(whole.embedding, cut.embedding, atol=1e-4) and np.allclose(whole.weights, cut.weights, atol=1e-4)
