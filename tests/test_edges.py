"""Joins, walks, files and hooks at their edges, against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrywork.functions import dom, walk
from quarrywork.operators import chunking, copilot, dedup, extract, joins, operations, retrieval
from quarrywork.plans import catalog, jobs
from quarrywork.sources import fetch, files

PASSAGES = ["one two three four five six seven", '"quoted one two three four five six', "in", "e", "two three", "one two three four five six seven eight nine", "x" * 40, "", "None of it"]
TEXTS = ["zone two three four five six sevens", 'he said "quoted one two three four five six" twice', "nine", "", "in one two three", "x" * 50, "one  two three four five six seven"]


@pytest.mark.parametrize("sent", [100_000, 0])
def test_containing_is_contains(spark, monkeypatch, sent):
    monkeypatch.setattr(joins, "SENT_KEYS", sent)
    passages = spark.createDataFrame(list(enumerate([*PASSAGES, "in"])), "p int, passage string")
    texts = spark.createDataFrame(list(enumerate([*TEXTS, None])), "t int, body string")
    got = sorted((r.t, r.p) for r in joins.containing(passages, "passage", texts, "body").collect())
    assert got == sorted((t, p) for t, body in enumerate(TEXTS) for p, passage in enumerate([*PASSAGES, "in"]) if passage and passage in body)
    both = sorted((r.t, r.p) for r in joins.holding_each_other(texts, "body", passages, "passage").collect())
    assert both == sorted((t, p) for t, body in enumerate(TEXTS) for p, passage in enumerate([*PASSAGES, "in"]) if passage and body and (passage in body or body in passage))


def test_first_region_wins(spark):
    points = spark.createDataFrame([(1, "k", 5.0), (2, "k", 15.0), (3, "k", 99.0), (4, "j", 5.0), (5, "k", 10.0)], "id int, key string, y double")
    regions = spark.createDataFrame([("k", "b", 0.0, 10.0), ("k", "a", 4.0, 20.0), ("k", "c", 4.0, 20.0)], "key string, name string, lo double, hi double")
    got = joins.in_region(points, regions, ["key"], "y", "lo", "hi", "name", ["id"]).collect()
    assert sorted((r.id, r.name) for r in got) == [(1, "a"), (2, "a"), (5, "a")]


def test_rectangles_on_a_grid(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "k", *(float(v) for v in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers(0, 30, (150, 4)) / 1.5 - 7)]
    rows = [r if r[4] >= r[2] and r[5] >= r[3] else (*r[:2], r[2], r[3], r[2] + 1, r[3] + 1) for r in rows] + [(999, "k", -100.0, -100.0, 100.0, 100.0)]
    frame = spark.createDataFrame(rows, "id int, key string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.a, r.b) for r in joins.rectangles_meet(frame, frame, ["key"]).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5])


@pytest.mark.parametrize("chunk,swept,looked_at,kind", [(20_000, 50_000, 1 << 19, "double"), (20, 30, 50, "double"), (7, 1, 1, "int"), (20_000, 1, 1, "int")])
def test_rectangles_of_one_table(spark, monkeypatch, chunk, swept, looked_at, kind):
    """Pairs once, the smaller id first: ties, crowded cells, flat and inverted rectangles, nulls, ids of two rows, and text as id."""
    for name, value in (("CHUNK", chunk), ("SWEPT", swept), ("LOOKED_AT", looked_at)):
        monkeypatch.setattr(joins, name, value)
    rng = np.random.default_rng(2)
    number = int if kind == "int" else lambda v: float(v) / 1.5 - 7
    rows = [(int(i), "kj"[i % 7 == 0], *(number(v) for v in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers([0, 0, -2, -2], [12, 30, 14, 9], (200, 4)))]
    rows += [(999, "k", *(number(v) for v in (-30, -30, 60, 60))), (3, "k", *rows[8][2:]), (None, "k", *rows[8][2:]), (1000, None, *rows[8][2:]), (1001, "k", None, *rows[8][3:])]
    frame = spark.createDataFrame(rows, f"id int, key string, x0 {kind}, y0 {kind}, x1 {kind}, y1 {kind}")
    known = [r for r in rows if None not in r]
    expected = [(a[0], b[0]) for a in known for b in known if a[0] < b[0] and a[1] == b[1] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]]
    assert sorted((r.a, r.b) for r in joins.rectangles_among(frame, ["key"], "id").collect()) == sorted(expected)
    named = joins.rectangles_among(frame.withColumn("id", F.format_string("%04d", "id")).filter("id <> 'null'"), ["key"], "id").collect()
    assert sorted((int(r.a), int(r.b)) for r in named) == sorted(expected)
    assert joins.rectangles_among(frame.limit(0), ["key"], "id").count() == 0


def test_spatial_intersect_looks_at_few_pairs(spark):
    """No join of a cell's rectangles with each other in the query's plan."""
    plan = catalog.QUERIES["spatial_intersect"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_first_and_last_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", None, "y"), ("a", 1, "z"), (None, 1, "n"), (None, 3, "m")], "k string, o int, v string")
    assert sorted((r.k or "", r.v) for r in dedup.first_seen(rows, ["k"], "o").collect()) == [("", "n"), ("a", "y")]
    assert sorted((r.k or "", r.v) for r in dedup.last_seen(rows, ["k"], "o").collect()) == [("", "m"), ("a", "x")]
    assert dedup.first_seen(rows.limit(0), ["k"], "o").count() == 0


def test_walk_has_no_depth(spark):
    deep = value = "leaf"
    for i in range(30):
        value = {"k": value} if i % 2 else [value]
    rows = [(1, json.dumps({"a": {"b": [1, {"c": None}]}, "e": {}, "s": "x"})), (2, json.dumps(value)), (3, "not json"), (4, None), (5, "7")]
    got = {(r.id, r.path): r.value for r in walk.leaves(spark.createDataFrame(rows, "id int, j string"), "j").collect()}
    assert got[1, "a.b.[0]"] == "1" and got[1, "s"] == "x" and (1, "a.b.[1].c") in got and got[5, ""] == "7"
    assert [v for (i, p), v in got.items() if i == 2] == [deep] and {i for i, _ in got} == {1, 2, 5}


def test_rendering_has_no_depth():
    assert dom.render(dom.tree("<div>" * 20_000 + "<a href=/x>deep</a>" + "</div>" * 20_000), "http://h/") == "[deep](http://h/x)"
    page = dom.tree("<div><p>a <b>b</b><br>c</p><ul><li>one</li><li>two <a href='#x'>t</a></li></ul></div>")
    assert dom.render(page, "") == "a b\nc\n\n- one\n- two t"
    assert page.raw().split() == ["a", "b", "c", "one", "two", "t"] and [n.tag for n in page.walk()] == ["div", "p", "b", "br", "ul", "li", "li", "a"]


def test_lines_are_numbered_through_splits(spark, tmp_path):
    row = lambda i: {"doc_id": f"d{i}", "source": "s", "source_type": "web", "title": "t", "content": f"c{i}"}
    (tmp_path / "a_documents.jsonl").write_text("".join(json.dumps(row(i)) + "\n" + "\n" * (i % 3) for i in range(400)))
    (tmp_path / "b_documents.jsonl").write_text("".join(json.dumps(row(i)) + "\n" for i in range(400, 500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert [r.doc_id for r in files.canonical(spark, str(tmp_path)).collect()] == [f"d{i}" for i in range(500)]
        lines = {r.value: r.line for r in files.numbered_lines(spark, str(tmp_path), "a_*").filter("value <> ''").collect()}
        assert [lines[json.dumps(row(i))] for i in (0, 1, 2, 3, 399)] == [1, 2, 4, 7, 799]
        with open(tmp_path / "b_documents.jsonl", "a") as f:
            f.write("{broken\n")
        with pytest.raises(Exception, match="b_documents.jsonl, line 101"):
            files.canonical(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_index_and_page_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", ""), (None, "z")], "chunk_id string, text string")
    files.write_index(chunks, f"{tmp_path}/index")
    assert [r.chunk_id for r in files.read_index(spark, f"{tmp_path}/index").collect()] == ["a"]
    files.write_index(chunks.filter("chunk_id = 'b'"), f"{tmp_path}/index")
    with pytest.raises(ValueError, match="empty"):
        files.read_index(spark, f"{tmp_path}/index")
    files.write_jsonl(chunks, f"{tmp_path}/jsonl")
    assert spark.read.json(f"{tmp_path}/jsonl").count() == 3
    pages = spark.createDataFrame([("p", '{"id": "p"}'), ("q", None)], "id string, json string")
    files.write_pages(pages, f"{tmp_path}/pages")
    assert [(r.page_id, r.value) for r in spark.read.text(f"{tmp_path}/pages").collect()] == [("p", '{"id": "p"}')]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "page.one.html").write_text("<p>a\nb</p>")
    assert [(r.page_id, r.html) for r in files.html_files(spark, f"{tmp_path}/h").collect()] == [("page.one", "<p>a\nb</p>")]


def test_collecting_configured_pages(spark, tmp_path):
    link = f"https://www.ica.gov.sg{fetch.VISA_LINKS[0]}india"

    def get(url):
        if url.endswith("city-sight-tour.html"):
            return 500, ""
        return 200, f"<html>\n<a href='{link}'>India</a>\n</html>" if "visa" in url else "<p>tour\n\n</p>"

    pages = {r.page_id: r for r in jobs.collect(spark, get, str(tmp_path)).collect()}
    assert len(pages) == 7 and pages["city_sights_tour"].fetch_status == "failed" and pages["city_sights_tour"].html_path is None
    assert pages["india"].link_text == "India" and pages["india"].discovered_from == fetch.VISA_PAGES[0][3]
    landed = {r.page_id: r.html for r in files.landed_pages(spark, f"{tmp_path}/start").collect()}
    assert landed["free_sg_tour"] == "<p>tour\n\n</p>" and len(landed) == 5
    counts = spark.read.json(f"{tmp_path}/manifest/summary").head()
    assert (counts.total_count, counts.successful_count, counts.failed_count) == (7, 6, 1)


def test_sizes_of_collections(spark):
    html = "<html><body><main><h1>T</h1><p>x</p><table><tr><th>a</th></tr><tr><td>1</td></tr></table><a href='/l'>l</a></main></body></html>"
    done = extract.tour_pages(spark.createDataFrame([("p", "https://a.org/p", html)], "id string, url string, html string")).select("page.*")
    row = extract.extraction_summary(done).head()
    page = done.head()
    assert (row.table_count, row.link_count, row.section_count, row.registration_subsection_count) == (len(page.tables), 1, len(page.sections), 0) and row.table_count == 1


def test_models_of_embeddings(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", None, "abcd"] * 50)], "i int, text string")
    got = {r.i: list(r.embedding) for r in chunking.embed(rows, model=lambda texts: [[len(t), 3.0] for t in texts]).collect()}
    assert got[0] == pytest.approx([2 / 13**0.5, 3 / 13**0.5]) and got[1] == [0.0, 1.0] and got[149] == pytest.approx([0.8, 0.6])
    with pytest.raises(Exception, match="the model gave"):
        chunking.embed(rows, model=lambda texts: [[1.0]]).collect()


def test_evidence_of_a_topic(spark):
    rows = spark.createDataFrame([(1, "visa", 0, 2), (1, "fst", 0, 1), (1, "visa", 0, 1)], "request_id int, topic string, pos int, rank int")
    assert [r.rank for r in copilot.topic_evidence(rows, "visa").collect()] == [1, 2]
    cited = retrieval.topic_citations(spark.createDataFrame([(1, "visa", 0), (2, "visa", 0), (2, "visa", 1)], "request_id int, topic string, rank int"), {"visa": "VISA"}, "rank", request=("request_id",))
    assert sorted((r.request_id, r.citation) for r in cited.collect()) == [(1, "VISA1"), (2, "VISA1"), (2, "VISA2")]


def test_words_without_an_index(spark):
    texts = ["drone permit drone", "the permit of a visa", "", None, "drone " * 50, "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame([(1, "drone permit permit"), (2, "visa"), (3, "the of")], "query_id int, text string")
    index = retrieval.postings(docs, "doc_id", "text")
    value = lambda df: sorted((r.query_id, r.doc, round(r.score, 9), r.rank) for r in df.collect())
    assert value(retrieval.search_words(docs, "doc_id", "text", asked)) == value(retrieval.bm25(index, *retrieval.statistics(docs, "doc_id", index), asked))


def test_questions_find_their_documents(spark, tmp_path):
    texts = {
        "customs": ("Penalties", "The composition amount for undeclared cigarettes is $200 a packet. Other goods are taxed."),
        "visa": ("Visa requirements India", "Indian passport holders need a visa to enter Singapore. Apply online."),
        "vftf": ("Visa Free Transit Facility", "An Indian national may use the Visa Free Transit Facility for 96 hours in transit."),
        "fst": ("Free Singapore Tour", "Requirements for joining the Free Singapore Tour: a layover of 5.5 hours, and no luggage."),
        "drone": ("Controlled items", "You may bring a drone into Singapore with a permit."),
        "other": ("Opening hours", "The library opens at nine."),
    }
    docs = spark.createDataFrame([(k, "s", "web", title, None, body, None, None) for k, (title, body) in texts.items()], "doc_id string, source string, source_type string, title string, heading_path string, content string, url string, page int")
    asked = [
        ("customs", "How much is the composition amount for undeclared cigarettes?"), ("visa", "Do Indian passport holders need a visa to enter Singapore?"), ("vftf", "Can an Indian national use the Visa Free Transit Facility?"),
        ("fst", "What are the requirements for joining the Free Singapore Tour?"), ("drone", "Can I bring a drone into Singapore?"),
    ]
    jobs.build_index(docs, f"{tmp_path}/index")
    questions = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(asked)], "query_id bigint, text string")
    found = {(r.query_id, r.citation): r.parent for r in jobs.evidence(files.read_index(spark, f"{tmp_path}/index"), docs, questions).collect()}
    assert [found[i, "S1"] for i in range(5)] == [k for k, _ in asked] and "other" not in found.values()


def test_what_is_shown(spark):
    sessions = spark.createDataFrame([("a", 0), ("b", 3), ("c", 4), ("d", None)], "code string, remaining_slots int")
    assert [(r.few_slots, r.bookable) for r in operations.offers(sessions).orderBy("code").collect()] == [(True, False), (True, True), (False, True), (True, False)]
    rows = spark.createDataFrame([(1, t, 0, n) for t in ("visa", "fst") for n in (5, 2, 4, 1, 3)], "request_id int, topic string, pos int, rank int")
    assert sorted((r.topic, r["rank"]) for r in copilot.traced(rows).collect()) == [(t, n) for t in ("fst", "visa") for n in (1, 2, 3)]
