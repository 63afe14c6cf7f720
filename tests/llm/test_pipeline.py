"""The pipeline's stages on a small corpus, held against what they must do."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, prose, tmp_path):
    leak = prose(77, 30)
    rows = [(i, prose(i, 60), "en", "s", 1) for i in range(60)]
    rows += [(100, prose(3, 60), "en", "s", 1), (101, prose(8, 40) + " " + leak, "en", "s", 1), (102, prose(999, 60) + " x.y@mail.example.com", "en", "s", 1)]
    rows += [(200 + i, "!! ".join(["JUNK"] * 50) + str(i), "en", "s", 1) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200)) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert not {i for i in seen[0] if i >= 200} and set(range(60)) <= set(seen[0])
    assert 100 not in seen[1] and 3 in seen[1]
    assert 101 in seen[1] and 101 not in seen[2]
    assert set(range(60)) <= set(seen[3]) and seen[3][102].endswith("<EMAIL>")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == pieces.count()


CLASHES = ["stats", "stats_", "_score", "id", "node", "digest", "root", "key", "spans", "start", "length", "bucket", "ids"]


def odd_root(spark, prose, folder, documents):
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(documents, schema)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("extra"))
    df.write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(i % 3 != 0)) for i in range(30)] + [(None, 1), (3, None)]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(1, 30)), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, prose, tmp_path, k):
    """Nulls in any column, empty and very long texts, repeated rows, ties and
    clashing columns."""
    long = prose(1, 30_000)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word", "en", "s", 4), (3, "word", "en", "s", 4), (None, "no key here", "en", None, 1), (4, long, None, "s", len(long)), (5, long, "de", "s", len(long)), (6, prose(6, 80) + " a.b@c.example", "en", "s", 1)]
    docs = odd_root(spark, prose, str(tmp_path), rows)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    if name != "packing":
        assert out.columns == docs.columns and set(got) <= {-1, 1, 2, 3, 4, 5, 6}
    if name == "near_duplicates":
        assert got == [-1, 1, 3, 4, 6]  # null and empty are one class, as are copies
    if name == "decontamination":
        assert got == [-1, 1, 2, 3, 3, 6]
    if name == "pii":
        rows = {r.doc_id: r for r in out.collect()}
        assert got == [-1, 1, 2, 3, 3, 4, 5, 6] and rows[1].text is None and rows[1].n_chars is None
        assert rows[6].text.endswith("<EMAIL>") and rows[6].n_chars == len(rows[6].text)
    if name == "packing":
        assert {-1, 1, 2, 3, 4, 5, 6} == set(got) and got.count(1) == 1 and got.count(3) >= 2


@pytest.mark.parametrize("k", range(5))
def test_stages_on_empty_tables(spark, prose, tmp_path, k):
    docs = odd_root(spark, prose, str(tmp_path), [])
    assert corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).count() == 0


def test_quality_stage_judges_rows_by_themselves(spark, prose, tmp_path):
    junk = "!! ".join(["JUNK"] * 50)
    rows = [(i, prose(i, 60) if i % 3 else junk + str(i), "en", "s", 1) for i in range(90)] + [(1, junk, "en", "s", 1), (7, prose(7, 60), "en", "s", 1)]
    docs = odd_root(spark, prose, str(tmp_path), rows)
    spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(90)], "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    kept = [r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()]
    assert sorted(kept) == sorted([i for i in range(90) if i % 3] + [7])
