"""Searches over all matching rows, against brute force."""

from __future__ import annotations

from stratafold import catalogue
from stratafold.operators.search import bm25, hybrid_search


def test_hybrid_search_ranks_all_rows(spark):
    # By distance the order is 0, 1, 2, ...; by text another one, in which near rows come late.
    n = 400
    data = [(i, [float(i), 0.0], " ".join(["steel"] * (1 + (i * 37 + 150) % n) + ["x"] * (n - (i * 37 + 150) % n)) if i % 3 else "x") for i in range(n)]
    df = spark.createDataFrame(data, "id int, v array<float>, body string").coalesce(1)
    for k in (1, 10, 30):
        text = [r.id for r in bm25(df, ["body"], "steel").collect()]
        score = {r.id: r._score for r in bm25(df, ["body"], "steel").collect()}
        by_text = {i: p for p, i in enumerate(sorted(text, key=lambda i: (-score[i], i)), 1)}
        want = {i: 1 / (60 + i + 1) + (1 / (60 + by_text[i]) if i in by_text else 0.0) for i in range(n)}
        best = sorted(want, key=lambda i: (-want[i], i))[:k]
        got = hybrid_search(df, "v", [0.0, 0.0], "body", "steel", k).collect()
        assert [r.id for r in got] == best and all(abs(r._hybrid_score - want[r.id]) < 1e-12 for r in got)


def test_any_terms_has_no_limit(spark, tmp_path):
    spark.createDataFrame([(i, "rights" if i % 2 else "none") for i in range(50)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.QUERIES["fts_any_terms"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in found.collect()) == list(range(1, 50, 2))
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
