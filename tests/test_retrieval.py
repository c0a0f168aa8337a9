import pytest
from pyspark.sql import functions as F

from quarrywork.operators import chunking, dedup, joins, retrieval, sections
from quarrywork.plans import jobs


def ranked(spark, rows, score):
    return spark.createDataFrame(rows, f"query_id int, doc string, rank int, {score} double")


def test_fusion_is_symmetric_and_ties_keep_vector_order(spark):
    v, w = ranked(spark, [(1, "a", 1, 0.1), (1, "b", 2, 0.2)], "distance"), ranked(spark, [(1, "c", 1, 9.0), (1, "b", 2, 8.0)], "score")
    rows = {r.doc: r for r in retrieval.fuse(v, w).collect()}
    assert rows["b"].fusion_score == pytest.approx(2 / 62) and rows["b"].position == 1
    assert rows["a"].fusion_score == rows["c"].fusion_score and (rows["a"].position, rows["c"].position) == (2, 3)


def test_rerank_clamps_defaults_and_last_score_wins(spark):
    c = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2), (1, "c", 0.3, 3)], "query_id int, doc string, fusion_score double, position int").withColumn("rank", F.col("position"))
    s = spark.createDataFrame([(1, "b", 150, "x", 0), (1, "a", 90, "old", 0), (1, "a", -5, "new", 1)], "query_id int, doc string, relevance int, reason string, pos int")
    rows = {r.doc: r for r in retrieval.rerank(c, s).collect()}
    assert (rows["b"].rerank_score, rows["a"].rerank_score, rows["a"].reason, rows["c"].reason) == (100, 0, "new", retrieval.UNSCORED)
    assert [r.rank for r in (rows["b"], rows["a"], rows["c"])] == [1, 2, 3]


def test_missing_parent_is_an_error_and_no_evidence_an_answer(spark):
    r = spark.createDataFrame([(1, "a", 0.5, 1, 80, "p", 1)], "query_id int, doc string, fusion_score double, position int, rerank_score int, parent string, rank int")
    docs = spark.createDataFrame([("q", "text")], "parent string, content string")
    with pytest.raises(Exception, match="No parent document"):
        retrieval.expand(r, docs).collect()
    none = retrieval.expand(r.withColumn("rerank_score", F.lit(59)), docs).withColumn("block", F.lit(""))
    asked = spark.createDataFrame([(1, "x")], "query_id int, text string")
    assert retrieval.answers(asked, none).head().answer == retrieval.NOTHING_FOUND


def test_documents_to_evidence(spark, tmp_path):
    rows = [("d1", "s", "web", "Drones", "Goods > Drones", "A drone needs a permit before it may be flown. " * 3, None, None, None), ("d2", "s", "web", "Fruit", "Goods > Fruit", "Fruit may be brought in small amounts. " * 60, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, source_type string, title string, heading_path string, content string, url string, page int, metadata string")
    counts = jobs.build_index(docs, f"{tmp_path}/index").head()
    assert (counts.parents, counts.split_parents) == (2, 1) and counts.chunks > 3
    asked = spark.createDataFrame([(1, "drone permit")], "query_id bigint, text string")
    found = jobs.evidence(spark.read.parquet(f"{tmp_path}/index"), docs, asked).collect()
    assert [(r.citation, r.parent) for r in found] == [("S1", "d1")] and found[0].block.startswith("[S1]\nTitle: Drones")


def test_chunk_ids(spark):
    docs = spark.createDataFrame([("d", "s", "web", "T", "A > t", "x" * 5000, None, 3)], "doc_id string, source string, source_type string, title string, heading_path string, content string, url string, page int")
    rows = chunking.children(docs).orderBy("chunk_index").collect()
    assert rows[0].chunk_id == "d::child-000" and rows[-1].chunk_index == len(rows) - 1 == rows[0].chunk_count - 1 and rows[0].page == "3"


def test_dedup_keeps_the_first_place_of_the_best(spark):
    rows = spark.createDataFrame([(0, "A", 1), (1, "b", 5), (2, "a ", 9), (3, "a", 9)], "seq int, t string, p int")
    kept = dedup.best_by_priority(rows, F.lower(F.trim("t")), F.col("p"), "seq").orderBy("position").collect()
    assert [(r.seq, r.position) for r in kept] == [(2, 0), (1, 1)]
    again = dedup.best_by_priority(spark.createDataFrame(kept).drop("position"), F.lower(F.trim("t")), F.col("p"), "seq")
    assert again.count() == 2


def test_coverage_guard(spark):
    long = "x" * 40
    texts = spark.createDataFrame([("abc",), (f"{long} and more",), ("short",), ("",)], "t string")
    covers = spark.createDataFrame([(long,), ("shor",), ("abc",)], "c string")
    assert [r.t for r in dedup.uncovered(texts, "t", covers, "c").collect()] == ["short"]


def test_merge_with_precedence(spark):
    left = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "k int, t string, n int")
    right = spark.createDataFrame([(2, "B"), (1, ""), (3, "c")], "k int, t string")
    assert sorted((r.k, r.t, r.n) for r in joins.merged(left, right, "k", ["t"]).collect()) == [(1, "a", 7), (2, "B", 8), (3, "c", None)]


def test_levels_of_headings(spark):
    rows = spark.createDataFrame([(0, "f", "H", None), (1, "f", "sub", None), (2, "f", None, None), (3, "f", "H2", 2), (4, "f", "next", None)], "pos int, f string, h string, k int")
    out = sections.heading_levels(rows, ["f"], "pos", F.col("h").isNotNull(), F.col("k")).orderBy("pos").collect()
    assert [r.level for r in out] == [1, 2, None, 2, 2]


def test_stemmed_postings_add_up(spark):
    docs = spark.createDataFrame([(1, "Cats and cat"), (2, None)], "id int, t string")
    assert [(r.term, r.tf) for r in retrieval.postings(docs, "id", "t", stem=True).collect()] == [("cat", 2)]


def test_nearest_in_blocks_against_every_pair(spark, monkeypatch):
    import numpy as np

    from quarrywork.functions.vectors import Nearest

    monkeypatch.setattr(retrieval, "SENT", 7)
    rng = np.random.default_rng(1)
    points = [[float(x) for x in rng.normal(size=4).round(1)] for _ in range(40)] + [[0.5, 0.5, 0.5, 0.5]] * 90 + [[1e-11, 1e200, 0.0, 1.0], [0.1, None, 0.2, 0.3], [1.0], [], None, [None] * 4]
    rows = list(enumerate(points))
    v = spark.createDataFrame(rows, "id bigint, e array<double>")
    asked = v.filter("id % 9 = 0 OR id >= 130").select(F.col("id").alias("query_id"), F.col("e").alias("query_vector"))
    got = {(r.query_id, r["rank"]): (r.doc, r.distance) for r in retrieval.nearest(v, "id", "e", asked, k=20, digits=9).collect()}

    def apart(a, b):
        both = [(x - y) ** 2 if abs(x - y) < 1e150 else float("inf") for x, y in zip(a or [], b or []) if x is not None and y is not None]
        return sum(both) if both else None

    for i, a in rows:
        if i % 9 == 0 or i >= 130:
            all_ = sorted((d is None, round(d, 9) if d is not None else 0, j) for j, b in rows for d in [apart(a, b)])[:20]
            assert [got[i, n + 1][0] for n in range(20)] == [j for *_, j in all_]
            assert [got[i, n + 1][1] is None for n in range(20)] == [none for none, *_ in all_]
    assert Nearest.QUESTIONS < Nearest.VECTORS  # products stay small


def test_questions_are_searched_for_once(spark):
    from quarrywork.plans import catalog

    searches = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert searches("parent_dedup_topk") == 1
    assert searches("rerank_left_join_clamp") == searches("evidence_threshold_expand_cite") == 0  # candidates are written
