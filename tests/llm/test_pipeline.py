"""The pipeline as a whole, on planted cases."""

import random

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    fresh = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    item = fresh(30)
    base = fresh(300)
    near = base.split()
    near[100], near[200] = "other", "words"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, fresh(200)), (5, fresh(20)), (6, None),
            (7, ""), (8, "same words here again " * 50), (9, f"{fresh(80)} {item} {fresh(80)}"),
            (10, f"{fresh(60)} password=abcdef123 {fresh(60)}"), (11, fresh(100) + " é 漢字 <|endoftext|>")]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint"
                          ).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        f"{at}/benchmark.parquet")
    return at, dict(rows)


def test_run(spark, folder):
    at, texts = folder
    rows = {r.doc_id: r for r in P.run(spark, at).collect()}
    assert set(rows) == {1, 4, 10, 11}
    assert rows[4].text == texts[4] and rows[4].round_trip and rows[4].n_tokens == len(rows[4].ids)
    assert "abcdef123" not in rows[10].text and rows[10].n_chars == len(rows[10].text)
    assert 50256 in rows[11].ids


def test_stages_keep_the_columns(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0
    assert P.STAGES[-1][1](spark, docs.limit(0), at).count() == 0
