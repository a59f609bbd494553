"""Registered training-data queries against their SQL, and the pipeline against its parts done by brute force."""

import random

import pytest

from tests.llm.test_llm_small import TOKENS, lines_left, near, prose
from tests.oracle import compare
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_each_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(1)
    clean = [prose(rng, 80) for _ in range(60)]
    item = prose(rng, 14)
    block = "\n".join(prose(rng, 9) for _ in range(3))
    texts = [*clean, "too short", "spam spam " * 40, clean[3], clean[5] + " tail", prose(rng, 50) + " " + item + " " + prose(rng, 30)]
    texts += [block + "\n" + prose(rng, 60), block + "\n" + prose(rng, 60), None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: list(r.ids) for r in c.run(spark, str(tmp_path)).collect()}
    kept = {i: t for i, t in enumerate(texts) if t and len(t.split()) >= 20 and "spam" not in t}
    left = {i: t for i, (t, n, gone) in lines_left(kept, 2).items() if not (gone and gone == n)}
    roots = near(left, 5, 80, 100)
    want = {i: TOKENS.encode_ordinary(t) for i, t in left.items() if roots[i][1] == i and item not in t}
    assert got == want


def test_stages_keep_columns_and_bear_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    rows = [(None, None, None, None, None, "k"), (1, "", "en", None, 0, "k"), (1, "word " * 30, None, "s", 150, "k"), (1, "word " * 30, None, "s", 150, "k")]
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert c.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
