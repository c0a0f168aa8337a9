"""Vectors and pages: recall against brute force, URL rules and wrappers, and tables of odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrywork.llm import imi, url_trie, wrappers

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EVERY = lambda i: F.lit(True)


# ---- 1: vectors


def brute(vectors, ids, q, k):
    scores = (vectors * vectors[q]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]]
    return [(int(ids[i]), scores[i]) for i in order[:k]]


@pytest.mark.parametrize("block", [16_384, 37])
def test_recall(spark, block):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    vectors[500:1500] = vectors[7]  # a third are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = imi.search(df, lambda i: F.pmod(i, F.lit(20)) == 0, k=10, centroids=16, least=200, block=block).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    ids = np.arange(len(vectors))
    hits = 0
    for q in range(0, 3000, 20):
        found = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11)) and [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        true = brute(vectors, ids, q, 10)
        hits += len({r.vec_id for r in found} & {i for i, _ in true})
        assert all(abs(r.score - vectors[q] @ vectors[r.vec_id]) < 1e-9 for r in found)
    assert hits >= 0.9 * 10 * 150


def test_recall_of_the_query(spark):
    """Production parameters on the table itself."""
    from quarrywork.llm import queries

    d = "/root/testdata/sf0.1"
    if not os.path.exists(d):
        pytest.skip("no larger tables")
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    ids, vectors = np.array(list(table)), np.array(list(table.values()))
    hits, asked = 0, 0
    found = {}
    for r in queries.QUERIES["op1_inverted_multi_index"](spark, d).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sorted(found) == sorted(i for i in table if i % 20 == 0)
    for at, i in enumerate(ids.tolist()):
        if i % 20 == 0:
            hits += len(found[i] & {j for j, _ in brute(vectors, ids, at, 20)})
            asked += 20
    assert hits >= 0.9 * asked


def test_rows_of_one_id_are_queries_of_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in [0, 0, 0, 1, 2, 3, 4, 4]]
    rows.append(rows[0])
    got = imi.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, k=3).collect()
    by = {}
    for r in got:
        by.setdefault((r.query_id, r.query_row), []).append((r.rank, r.vec_id, r.score))
    own = [np.array(v) for i, v in rows[:3]]
    others = [(i, np.array(v)) for i, v in rows if i != 0]
    expected = sorted([(n + 1, i, pytest.approx(s)) for n, (s, i) in enumerate(sorted(((float(q @ v), i) for i, v in others), key=lambda x: (-x[0], x[1]))[:3])] for q in own)
    assert len(by) == 3 and sorted(sorted(v) for v in by.values()) == expected


def test_the_table_gives_the_number_of_centroids():
    assert [imi.centroids_for(n) for n in (0, 1000, 50_000, 10**6, 10**8, 10**12)] == [64, 64, 64, 256, 1024, 1024]


def test_cells_come_in_order():
    rng = np.random.default_rng(1)
    a, b, counts = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 3, (9, 7))
    order = list(imi.traverse(a, b, counts, 1e9))
    assert [a[i] + b[j] for i, j in order] == sorted((a[i] + b[j] for i in range(9) for j in range(7) if counts[i, j]), reverse=True)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [0.5, 0.5]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "i", "rank", "score", "block")})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in imi.search(df, EVERY).collect()}
    assert {q for q, _ in got} == {1, 2, 9}
    assert got[1, 1] == (2, 1.0) and got[1, 2] == (9, 0.5) and (1, 3) not in got
    assert [got[2, r] for r in (1, 2, 3)] == [(1, 1.0), (1, 1.0), (9, 0.5)]
    assert imi.search(df.limit(0), EVERY).count() == 0 and imi.search(df.filter("vec_id = 4"), EVERY).count() == 0


# ---- 4: addresses

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b", "/x/y", "block"), ("a.b", "/x/", "allow"), ("a.b", "/x/y", "allow")]


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.COM/en/1?q", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/z#f", "x.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://example.com/en", "example.com", "/en", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://a.net/es/?x", "a.net", "/es/", "net/es/", "block"),
        ("http://net?/es/", "net", "", None, "allow"),
        ("http://a.b/x/yz", "a.b", "/x/yz", "a.b/x/y", "block"),
        ("http://a.b/x/", "a.b", "/x/", "a.b/x/", "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://É.com/", "É.com", "/", "com/", "allow"),
    ],
)
def test_rules(url, host, path, rule, verdict):
    trie = url_trie.UrlTrie(RULES)
    assert url_trie.host_and_path(url) == (host, path)
    found = trie.lookup(host, path)
    assert (found or (None, "allow")) == (rule, verdict)


def test_url_table(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/"), (1, "http://a.net/es/"), (None, None)], "page_id long, url string").withColumn("rule", F.lit(0))
    got = url_trie.filter_urls(df, RULES).collect()
    assert sorted((str(r.page_id), str(r.rule)) for r in got) == [("1", "net/es/"), ("1", "net/es/"), ("None", "None")]
    assert url_trie.filter_urls(df.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        url_trie.UrlTrie([("a", "/", "maybe")])


# ---- 10: pages


def wrapper_of(*pages):
    own = None
    for page in pages:
        one = wrappers.infer(wrappers.parse(page))
        own = one if own is None else wrappers.unite(own, one)
    return wrappers.prepare(wrappers.load(wrappers.dump(own)))


def text_of(page, *others):
    return wrappers.cut(wrappers.parse(page), wrapper_of(page, *others))


WORDS = "Some words of an article that go on for a while and say things, "


def test_article_without_chrome():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="ad">Buy</div><div class="cookie-notice">We use</div><aside>Side</aside><article><header><h1>Head &amp; foot</h1></header><p><b>{WORDS}<br><p>two&nbsp;&nbsp; three <i>four</i>five
    <form><p>form</form><div class="share">Share</div><ul><li>point one<li>point two</ul><section id="comments"><p>First!</section></article><footer>&copy; x"""
    assert text_of(page) == f"Head & foot\n{WORDS.strip()}\ntwo three fourfive\npoint one\npoint two"


def test_region_without_article_elements():
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Menu {i}</a></li>" for i in range(5)) + "</ul></div>"
    a = f"<body>{menu}<div><div><h2>A</h2><p>{WORDS * 3}</p></div></div><div class=footer>f</div></body>"
    b = f"<body>{menu}<div><div><h2>B</h2><p>{WORDS}</p><blockquote>quote</blockquote><p>{WORDS}</p></div></div><div class=footer>f</div></body>"
    assert text_of(b, a).split("\n") == ["B", WORDS.strip(), "quote", WORDS.strip()] and text_of(a, b).split("\n")[0] == "A"


def test_alignment_makes_optional_and_repeated_groups():
    a = wrappers.infer(wrappers.parse("<div><h2>x</h2><p>y</p><h2>x</h2><p>y</p></div>"))
    b = wrappers.infer(wrappers.parse("<div><h2>x</h2><p>y</p><ul><li>z</ul></div>"))
    assert wrappers.expression(wrappers.unite(a, b)) == "<><div>(<h2>#</><p>#</>)+<ul><li>#</></>?</></>"
    assert wrappers.expression(wrappers.unite(b, a)) == wrappers.expression(wrappers.unite(a, b))
    six = "".join(f"<h{i}>x</h{i}>" for i in range(1, 7))
    assert wrappers.expression(wrappers.infer(wrappers.parse(six * 3))).endswith("<h6>#</>)+</>")


def numbered(n, at, extra="", length=9):
    """A page without article elements or names; its advert is sometimes longer than its article."""
    words = " ".join(f"w{n}x{i}" for i in range(length))
    return f"<body><div>Our site, the best of all sites there are</div><div><h1>Head {n}</h1><p>Always the same words stand here.</p><p>{words}</p>{extra}</div><div>{'Buy this now ' * at} {n}</div></body>"


def test_template_texts_and_short_articles_need_the_wrapper():
    pages = [numbered(i, 1 if i else 40, length=60 if i else 9) for i in range(12)]
    texts = [f"Head {i}\n" + " ".join(f"w{i}x{j}" for j in range(60 if i else 9)) for i in range(12)]
    own = wrapper_of(*pages)
    assert [wrappers.cut(wrappers.parse(p), own) for p in pages] == texts
    nothing = wrapper_of("")
    assert not any(wrappers.cut(wrappers.parse(p), nothing) == t for p, t in zip(pages, texts))
    # copies of one page have no template that could be told from its text
    copy = pages[3]
    assert "Always the same words" in wrappers.cut(wrappers.parse(copy), wrapper_of(*[copy] * 9))


def test_pages_of_two_templates_on_a_host():
    long = [f"<body><div class=a><p>{WORDS} {i}</p><p>{WORDS * 9}{i}</p></div><div class=tail>x{i}</div></body>" for i in range(20)]
    short = [f"<body><section><div class=b><p>minor {i}</p><p>{WORDS}</p></div></section></body>" for i in range(2)]
    own = wrapper_of(*long, *short)
    assert wrappers.cut(wrappers.parse(short[1]), own) == f"minor 1\n{WORDS.strip()}"
    assert wrappers.cut(wrappers.parse(long[1]), own).startswith(WORDS.strip())


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p class=it's>Hello <b>brave</b> world</p><p>don't stop</p><p>end</p>", "Hello brave world\ndon't stop\nend"),
        ('<p title="unclosed>Hello</p><p class="x">there</p>', "Hello\nthere"),
        ("<p title='a > b' data-x=\"c > d\">Hello</p>", "Hello"),
        ('<div class="alert-free"><p>kept</p></div><div class="text-social-history"><p>and this</p></div><div class="ad-banner"><p>not</p></div><div class="siteFooter">not</div>', "kept\nand this"),
        ("<div><b>bold<p>in a block</b> and on</p>x</div>", "bold\nin a block and on\nx"),
        ("<p>one<br>two<hr>three</p>", "one\ntwo\nthree"),
        ("<form id=all><div><h1>T</h1><p>The whole page is in a form.</p></div></form>", "T\nThe whole page is in a form."),
        ("a < b &amp;&lt;&nbsp; c </b></zz> <", "a < b &< c <"),
        ("<li>a<li>b</p></div></x>c", "a\nb\nc"),
    ],
)
def test_malformed_pages(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep", "<b>" * 100_000 + "deep", "<ul><li>" * 50_000 + "deep", "<p><i>" * 50_000 + "deep", "<b></div>" * 50_000 + "deep", "<div><b></i>" * 40_000 + "deep"])
def test_depth_has_no_limit(page):
    assert text_of(page) == "deep"


def test_large_wrappers_are_pruned_and_long_sequences_align():
    odd = "<body>" + "".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}><p>t{i}</p></div>" for i in range(3000)) + "</body>"
    own = wrappers.infer(wrappers.parse(odd))
    both = wrappers.unite(own, wrappers.infer(wrappers.parse("<body><p>a</p></body>")))
    assert len(wrappers.preorder(wrappers.pruned(wrappers.unite(both, own)))) <= wrappers.ITEMS
    assert text_of(odd, "<body><p>a</p></body>").count("\n") == 2999


def test_odd_pages(spark):
    rows = [(1, "http://a.org/1", None), (2, "http://a.org/2", ""), (3, None, "<p>text</p>"), (4, "nonsense", "plain < text & more"), (1, "http://a.org/1", None), (5, "http://a.org/3", "<article>" + "<p>w " * 20_000), (None, "http://a.org/4", "<article><p>x</p><p>x</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "text", "wrapper", "shape")})
    got = {(r.page_id, r.url): r for r in wrappers.extract(df).collect()}
    assert got[1, "http://a.org/1"].text == "" and got[3, None].text == "text" and got[4, "nonsense"].text == "plain < text & more"
    assert got[5, "http://a.org/3"].n_chars == 39_999 and got[None, "http://a.org/4"].text == "x\nx" and len(got) == 6
    joined = wrappers.extract(df, most_sent=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, wrappers.extract(df).collect()))
    assert wrappers.extract(df.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    import html
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in wrappers.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_merging_in_rounds_gives_the_same_texts(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").repartition(6).withColumn("host", F.lit("one"))
    whole = {r.host: wrappers.load(r.wrapper) for r in wrappers.wrappers(pages).collect()}
    rounds = {r.host: wrappers.load(r.wrapper) for r in wrappers.wrappers(pages, fan=3, most=4).collect()}
    assert whole.keys() == rounds.keys() and whole["one"].n == rounds["one"].n == pages.count()
    assert all(sum(i.c for _, i in wrappers.preorder(w)) == sum(i.c for _, i in wrappers.preorder(whole["one"])) for w in rounds.values())


def test_pages_without_names(spark):
    """The articles are found where neither an article element nor a class names them."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for old, new in (("<article>", "<div>"), ("</article>", "</div>"), (' class="ad"', "")):
        pages = pages.withColumn("html", F.replace("html", F.lit(old), F.lit(new)))
    plain = {r.page_id: r.text for r in wrappers.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    bare = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert sum(bare[i] == t for i, t in plain.items()) >= 0.95 * len(plain)
