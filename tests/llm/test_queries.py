import duckdb
import pytest

import corpus_pipeline
from trailmark.llm import queries, simhash, substrings

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, made.select(names).collect()))) == sorted(map(repr, want.fetchall()))


def test_one_query_an_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{n}" for n in range(1, 14)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == columns
    clean, unique, cut, mixed = kept[1:]
    assert {r.doc_id for r in clean.collect()} <= {r.doc_id for r in docs.collect()}
    groups = {r.doc_id: r.component_id for r in simhash.near_copies(clean).collect()}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(groups.values()))
    removed = {r.doc_id: r.n_removed for r in substrings.dedup_digest(unique).collect()}
    texts = {r.doc_id: r.text for r in unique.collect()}
    for r in cut.collect():
        assert r.n_chars == len(r.text)
        if not removed[r.doc_id]:
            assert r.text == texts[r.doc_id]
        else:
            assert len(r.text.encode()) <= len(texts[r.doc_id].encode()) - removed[r.doc_id]
    assert {r.doc_id for r in mixed.collect()} <= set(texts)
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    assert last.count() == mixed.count()


def test_run_is_all_stages(spark):
    made = corpus_pipeline.run(spark, SF)
    assert made.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and made.count() > 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No documents, no labels, nulls in every column, empty texts, repeated rows and a column of a clashing name."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long"
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(1, "one two three four five six", "en", "a", 27, 1), (1, "one two three four five six", "en", "a", 27, 1), (2, None, None, None, None, None),
            (3, "", "de", "b", 0, 2), (None, "a text without a name", "fr", "c", 21, 3), (4, long, "en", None, len(long), 4), (5, long + " more", "en", "a", 9, 5)]
    for name, some in (("none", []), ("odd", rows)):
        at = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    made = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in made} <= {None, 1, 2, 4} and {r.doc_id for r in made} >= {1, 4}
