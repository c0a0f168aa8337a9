import json

from quarrywork.operators import copilot
from quarrywork.plans import jobs
from quarrywork.sources import operational


def test_links_of_documents(spark):
    meta = json.dumps({"links": [{"text": "Form", "url": "/form."}, {"label": "Twice", "href": "https://a.org/p"}], "n": 1})
    content = "see [md](https://b.org/x), <a href=\"https://c.org\">c</a> and https://b.org/x or https://d.org/y."
    docs = spark.createDataFrame([("d", "Page", "https://a.org/p", meta, content), ("e", "t", None, None, None)], "doc_id string, title string, url string, metadata string, content string")
    got = [(r.label, r.url) for r in copilot.document_links(docs, "https://a.org").orderBy("n").collect()]
    assert got == [("Page", "https://a.org/p"), ("Form", "https://a.org/form"), ("md", "https://b.org/x"), ("c", "https://c.org"), ("Official resource", "https://d.org/y")]


def test_requests_to_answers(spark, tmp_path):
    rows = [("d1", "ICA", "web", "Drones", "Goods > Drones", "A drone needs a permit before it may be flown.", "https://a.org/d", None, "{}")]
    docs = spark.createDataFrame(rows, "doc_id string, source string, source_type string, title string, heading_path string, content string, url string, page int, metadata string")
    jobs.build_index(docs, f"{tmp_path}/i")
    index = spark.read.parquet(f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "Which tour between SQ12 on 2026-08-20 and SQ318?"), (2, "Which tour after SQ12?"), (3, "drone permit?"), (4, "hello")], "request_id bigint, text string")
    wanted = spark.createDataFrame([(3, 0, "customs", "drone  permit"), (3, 1, "customs", "Drone permit"), (2, 0, "visa", "x")], "request_id bigint, pos int, topic string, query string")
    ready = copilot.prepare(asked, operational.flights(spark), operational.sessions(spark), wanted, lambda q: jobs.evidence(index, docs, q)).cache()
    got = {r.request_id: r for r in ready.collect()}
    assert "Calculated transit duration: 13.25 hours" in got[1].operations and "session count: 4" in got[1].operations and got[1].digest.count("slots left") == 4
    assert got[2].direct_answer.startswith(copilot.MISSING) and "- arrival date" in got[2].direct_answer and got[2].knowledge is None
    assert got[3].knowledge.startswith("[CUSTOMS1]") and "https://a.org/d" in got[3].knowledge and got[3].direct_answer is None
    assert got[4].direct_answer == copilot.NOTHING_ROUTED
    said = {r.request_id: r.answer for r in copilot.run(ready).collect()}
    assert said[4] == copilot.NOTHING_ROUTED and "[OPS1]" in said[1] and "[CUSTOMS1]" in said[3]
