from quarrywork.sources import fetch


def test_children_are_allowed_last_and_in_order(spark):
    html = "<a href='/v/visa-detail-page/b#x'>B</a><a href='/v/visa-detail-page/a'>old</a><a href='/v/visa-detail-page/a/'>A  new</a><a href='/v/visa-detail-page/f.pdf'>p</a><a href='https://x.org/visa-detail-page/c'>c</a><a href='/other'>o</a>"
    pages = spark.createDataFrame([("https://www.ica.gov.sg/seed", html)], "url string, html string")
    got = fetch.children(pages, ["www.ica.gov.sg"], ["visa-detail-page"]).collect()
    assert [(r.page_id, r.link_text) for r in got] == [("a", "A new"), ("b", "B")]


def test_failures_are_rows(spark):
    def get(url):
        if url.endswith("boom"):
            raise RuntimeError("no route")
        return (404, "") if url.endswith("gone") else (200, "<p>")

    targets = spark.createDataFrame([("a", "u"), ("b", "boom"), ("c", "gone")], "page_id string, url string")
    got = {r.page_id: (r.http_status, r.fetch_status, r.error) for r in fetch.fetched(targets, get, tries=2, backoff=0).collect()}
    assert got == {"a": (200, "success", None), "b": (None, "failed", "no route"), "c": (404, "failed", "HTTP 404")}
