import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrywork.functions import dom, html, splitting, stems, urls
from quarrywork.functions import text as T


def one(spark, expression, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(expression).head()[0]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("probate", "probat"), ("controlling", "control"), ("sky", "sky"), ("as", "as")])
def test_porter(word, stem):
    assert stems.stem(word) == stem


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(20, 60))
def test_pieces_keep_to_the_limit_and_lose_no_letter(text, limit):
    parts = splitting.split_text(text, limit, limit // 5)
    assert all(len(p) <= limit for p in parts)
    assert set("".join(parts)) - set(" \n") == set(text) - set(" \n")


def test_short_texts_stay_whole(spark):
    rows = spark.createDataFrame([("x" * 1200,), ("word " * 400,), ("",)], "t string").select(splitting.chunks(F.col("t")).alias("c")).collect()
    assert len(rows[0].c) == 1 and len(rows[1].c) > 2 and rows[2].c == [""]


def test_cleaning(spark):
    t = F.col("t")
    assert one(spark, T.paragraphs(t), t="\u00a0a\u00a0b\u200bc \n\n\n\n d <sly x>y</sly>") == "a bc\n\nd"
    assert one(spark, T.tidy_punctuation(t), t="a , b .") == "a, b."
    assert one(spark, T.comparison(t), t="A\n B") == "a b"
    assert one(spark, T.slug(t), t="--A & B!") == "a-b" and one(spark, T.slug(t, "_", "x"), t="!!") == "x"
    assert one(spark, T.without_footnotes(t), t="a [12] b") == "a b" and one(spark, T.strip_numbering(t), t="12. q") == "q"
    assert one(spark, T.clock(F.col("t").cast("double")), t="3.0833333") == "3h 05m" and one(spark, T.clock(F.col("t").cast("double")), t="1.9999") == "2h 00m"
    assert one(spark, T.terminal(t), t=" 3 ") == "T3"


def test_heading_paths(spark):
    parts = F.array(F.lit("A"), F.lit(""), F.lit("a "), F.lit("B"))
    assert one(spark, T.heading_path(parts), t="") == "A > B"
    assert one(spark, T.with_page_first(F.array(F.lit("B")), F.col("t")), t="A") == ["A", "B"]
    assert one(spark, T.with_page_first(F.array(F.lit("a")), F.col("t")), t="A") == ["a"]


def test_tables_as_text(spark):
    rows = F.array(F.array(F.lit("h1"), F.lit("")), F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit(""), F.lit("")))
    assert one(spark, T.records_text(rows), t="") == "h1: x\nColumn 2: y\nz"
    head, body = T.clean_table(F.array().cast("array<string>"), rows)
    assert one(spark, T.table_markdown(head, body), t="").startswith("h1 | \n--- | ---\nx | y | z")


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.canonical(u), u="HTTP://WWW.A.org/x/y/;p?q#f") == "http://www.a.org/x/y"
    assert one(spark, urls.page_id(u), u="https://a.org/b/My%20Page.html") == "my-page" and one(spark, urls.page_id(u), u="https://a.org/") == "index"
    for link, whole in (("/x", "https://a.org/x"), ("y", "https://a.org/b/y"), ("//c.org/z", "https://c.org/z"), ("#f", "https://a.org/b/c#f"), ("http://d.org", "http://d.org")):
        assert one(spark, urls.resolve(u, F.lit("https://a.org/b/c")), u=link) == whole
    assert one(spark, urls.resource(u, "https://a.org"), u=" /p., ") == "https://a.org/p"


PAGE = "<html><head><title>t</title><script>x<p></script></head><body><nav>menu</nav><h2>One</h2><p>a <a href='/l'>link</a><p>b<ul><li>i<li>j</ul><table><tr><th>h</th></tr><tr><td>c</td></tr></table><h2>Two</h2><p>z</body>"


def test_html():
    read = html.read(PAGE, "https://a.org/")
    assert read.text().split("\n")[:5] == ["One", "a [link](https://a.org/l)", "b", "- i", "- j"] and "menu" not in read.text()
    assert read.links == [("link", "https://a.org/l")] and read.tables[0]["rows"] == [["h"], ["c"]] and read.tables[0]["headers"] == ["h"]


def test_dom():
    root = dom.tree(PAGE)
    assert [n.words() for n in root.all("li")] == ["i", "j"] and root.first("table td").words() == "c"
    assert dom.render(root.first("ul"), "") == "- i\n- j" and root.first(".none") is None


def test_references_without_semicolon_stay_where_closed_ones_are_asked_for(spark):
    page = "<p>a &amp; b&amp;&lt;&#39;&#x27; &bogus; &ampx; 1&2 &amp</p><p>&amp"
    assert html.closed_text(page) == "a & b&<'' &bogus; &ampx; 1&2 &amp\n&amp"
    assert html.read("<p>x &amp").text() == "x &"  # as browsers do
    assert one(spark, html.page_text(F.col("t"), F.col("t"), closed=True), t="<p>that&&&amp") == "that&&&amp"
