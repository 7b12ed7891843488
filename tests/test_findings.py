"""Cases of review findings, each of which failed before its finding was settled."""

from dialoom.config import Retrieval
from dialoom.operators import retrieval, scenes


def test_equal_similarities_of_other_speakers_tie(spark):
    rows = [(1, i, [x], "x", i) for i, x in enumerate("dfbgcgcgcgceafbfbfgcgcgcgc")]
    made = spark.createDataFrame(rows, "ep long, i long, speakers array<string>, clean_text string, source_row long")
    near = {r.i: r.similarity for r in scenes.similarities(made).collect()}
    least = [i for i in range(1, 25) if near[i] <= 0.25 and all(near[j] is None or round(near[i], 9) <= round(near[j], 9) for j in (i - 1, i + 1))]
    assert 6 in least and sorted(r.i for r in scenes.candidates(made).collect()) == least


def test_boundaries_of_equal_strength_go_by_line():
    assert scenes.accept([(1.2, 8), (1.2 + 1e-12, 12)], 30, 6) == [8]


def _few(spark, n, of):
    """``n`` rows (chunk_id, text, vector) in one partition; ``of`` different ones, so that many tie."""
    rows = [(i, f"w{i % of} common" + " w1" * (i % of % 3), [1.0, float(i % of)], ["a" if i % 2 else "b"]) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, text string, vector array<double>, speakers array<string>").coalesce(1)


def test_only_the_best_of_all_blocks_leave_a_task(spark):
    rows = _few(spark, 60, 20).select("chunk_id", "vector")
    asked = rows.filter("chunk_id % 30 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = retrieval.dense_scores(rows, asked, block=7).filter("query_id <> chunk_id")
    assert exact.count() == 118
    best = retrieval.dense_scores(rows, asked, 3, block=7, others=True).collect()
    assert len(best) == 6 and not any(r.query_id == r.chunk_id for r in best)
    key = lambda r: (r.query_id, r["rank"], r.chunk_id, r.score)
    for k in (1, 3, 10, 50, 100):
        got = retrieval.top_k(retrieval.dense_scores(rows, asked, k, block=7, others=True), k).collect()
        assert sorted(map(key, got)) == sorted(map(key, retrieval.top_k(exact, k).collect()))


def test_bm25_scores_texts_whole(spark):
    rows = _few(spark, 90, 30)
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w5"), (3, "common"), (4, None), (5, "w1")], "query_id int, text string")
    key = lambda r: (r.query_id, r["rank"], r.chunk_id, r.score)
    for k in (1, 4, 40):
        for config in (Retrieval(), Retrieval(epsilon=0.25)):
            for some in (retrieval.Filters(), retrieval.Filters(speakers=("a",))):
                every = retrieval.bm25_scores(rows, asked, config).join(rows.filter(some.column()).select("chunk_id"), "chunk_id", "left_semi")
                assert sorted(map(key, retrieval.Bm25(rows, config).search(asked, k, some).collect())) == sorted(map(key, retrieval.top_k(every, k).collect()))
    assert retrieval.bm25_best(rows, asked, 4).count() <= 3 * 4
    assert "Exchange" not in retrieval.bm25_best(rows, asked, 4)._jdf.queryExecution().executedPlan().toString()
    assert retrieval.Bm25(rows).search(asked.filter("query_id = 4"), 4).count() == 0 and retrieval.Bm25(rows.limit(0)).search(asked, 4).count() == 0


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    retrieval.embed_words(_few(spark, 3, 3), "chunk_id")
    assert int(spark.conf.get(key)) <= 4 << 20
