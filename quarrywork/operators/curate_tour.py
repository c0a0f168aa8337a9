"""Tour pages to canonical documents and an image registry.

Six curators make documents of a page's structured parts and of the paragraphs
they don't cover; their union is deduplicated by text over all pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import dedup, sections

#: Fixed values.
PRIORITY = {"itinerary": 100, "registration_detail": 95, "faq": 90, "table": 85, "service_notice": 80, "location": 75, "tab_section": 60, "section": 40, "overview": 30}
LANDING = "free_sg_tour"
NOTICE = "scheduled maintenance|temporarily unavailable|resume on|we apologise|we apologize|currently unavailable"
SCHEDULE = "reporting time|tour timing|flight departure|tour itinerary"
LOCATION_FIELDS = (("Location", "location_name"), ("Level", "level"), ("Details", "details"), ("Phone", "phone"), ("Operating status", "operating_status"), ("Operating time", "operating_time"), ("Operating days", "operating_days"))
GUARD = 35

_SECTION = "STRUCT<heading: STRING, heading_path: ARRAY<STRING>, content: ARRAY<STRING>>"
_FAQ = "STRUCT<title: STRING, content: STRING, heading_path: ARRAY<STRING>>"
_TABLE = "STRUCT<caption: STRING, headers: ARRAY<STRING>, rows: ARRAY<ARRAY<STRING>>, notes: ARRAY<STRING>>"
_PLACE = "STRUCT<location_name: STRING, level: STRING, details: STRING, phone: STRING, operating_status: STRING, operating_time: STRING, operating_days: STRING, map_url: STRING>"
#: What a page looks like; absent parts are null.
PAGE = (
    "id STRING, name STRING, page_type STRING, url STRING, title STRING,"
    f" sections ARRAY<{_SECTION}>, registration_details STRUCT<title: STRING, subsections: ARRAY<STRUCT<title: STRING, content: STRING, items: ARRAY<STRUCT<label: STRING, content: STRING>>>>>,"
    " itineraries ARRAY<STRUCT<index: INT, title: STRING, description: STRING, image: STRUCT<url: STRING, alt: STRING>, source_component: STRING, slider_index: INT, slide_index: INT>>,"
    f" tabs ARRAY<STRUCT<title: STRING, content: STRING, sections: ARRAY<{_SECTION}>, accordions: ARRAY<{_FAQ}>, tables: ARRAY<{_TABLE}>, location_directory: STRUCT<locations: ARRAY<{_PLACE}>>>>,"
    f" accordions ARRAY<{_FAQ}>, tables ARRAY<{_TABLE}>, images ARRAY<STRUCT<url: STRING, alt: STRING, nearby_heading: STRING, nearby_text: STRING>>, links ARRAY<STRUCT<text: STRING, url: STRING>>"
)

clean = T.paragraphs


def _texts() -> Column:
    return F.array().cast("array<string>")


def _doc(branch: int, item: Column, doc_id: Column, path: Column, content: Column, kind: Column | str, related: bool = True, asset_url: Column | None = None, **metadata: Column) -> list[Column]:
    """A document before assets: related says that images are found by their text, asset_url names its own image."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    extra = F.to_json(F.struct(*[v.alias(k) for k, v in metadata.items()])) if metadata else F.lit("{}")
    return [
        F.col("id").alias("page_id"), F.coalesce("page_type", F.lit("tour")).alias("page_type"), F.lit(branch).alias("branch"), item.cast("long").alias("item"), doc_id.alias("doc_id"), F.coalesce("title", "name", F.lit("")).alias("title"),
        T.heading_path(T.with_page_first(T.non_empty(F.transform(path, clean)), clean(F.coalesce("title", "name", F.lit(""))))).alias("heading_path"), clean(content).alias("content"), "url", kind.alias("content_type"),
        F.lit(related).alias("related"), (asset_url if asset_url is not None else F.lit(None).cast("string")).alias("asset_url"), extra.alias("extra"),
    ]


def _id(part: str, n: Column) -> Column:
    return T.numbered(F.concat(F.lit("fst_"), F.col("id"), F.lit(f"_{part}")), "_", n, 3)


def registration(pages: DataFrame) -> DataFrame:
    s = pages.select("*", F.posexplode("registration_details.subsections").alias("i", "s"))
    name = T.first_of(clean(F.col("s.title")), F.concat(F.lit("Registration Detail "), (F.col("i") + 1).cast("string")))
    line = lambda x: F.when(clean(x["content"]) == "", None).when(clean(x["label"]) == "", clean(x["content"])).otherwise(F.concat(clean(x["label"]), F.lit(": "), clean(x["content"])))
    body = F.concat_ws("\n", F.nullif(clean(F.col("s.content")), F.lit("")), F.array_compact(F.transform("s.items", line)))
    parent = T.first_of(clean(F.col("registration_details.title")), F.lit("Registration Details"))
    return s.select(*_doc(0, F.col("i"), _id("registration", F.col("i") + 1), F.array(parent, name), body, "registration_detail", False, registration_section=name))


def itineraries(pages: DataFrame) -> DataFrame:
    s = pages.select("*", F.posexplode("itineraries").alias("i", "s")).filter((clean(F.col("s.title")) != "") | (clean(F.col("s.description")) != ""))
    name = T.first_of(clean(F.col("s.title")), F.concat(F.lit("Tour Stop "), (F.col("i") + 1).cast("string")))
    extra = {"itinerary_title": name, "itinerary_index": F.coalesce(F.col("s.index"), F.col("i") + 1), "source_component": F.col("s.source_component"), "slider_index": F.col("s.slider_index"), "slide_index": F.col("s.slide_index")}
    return s.select(*_doc(1, F.col("i"), _id("itinerary", F.col("i") + 1), F.array(F.lit("Tour Itinerary"), name), T.first_of(clean(F.col("s.description")), name), "itinerary", False, clean(F.col("s.image.url")), **extra))


def _table(t: Column) -> tuple[Column, Column, Column]:
    """Text, heading and notes of a table."""
    head, rows = T.clean_table(F.coalesce(t["headers"], _texts()), F.coalesce(t["rows"], F.array().cast("array<array<string>>")))
    notes = F.coalesce(T.non_empty(F.transform(t["notes"], clean)), _texts())
    listed = F.when(F.size(notes) > 0, F.concat(F.lit("Notes:\n"), F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n")))
    text = F.concat_ws("\n\n", F.nullif(T.table_markdown(head, rows), F.lit("")), listed)
    name = F.when(F.lower(F.array_join(head, " ")).rlike(SCHEDULE), "Tour Schedule").otherwise(T.first_of(clean(t["caption"]), F.lit("Table")))
    return text, name, notes


def tables(pages: DataFrame) -> DataFrame:
    s = pages.select("*", F.posexplode("tables").alias("i", "s"))
    text, name, notes = _table(F.col("s"))
    return s.select(*_doc(2, F.col("i"), _id("table", F.col("i") + 1), F.array(name), text, "table", False, table_caption=F.col("s.caption"), table_notes=notes))


def _faq(x: Column) -> tuple[Column, Column]:
    """The question without its number, and the path that ends in it."""
    question = T.strip_numbering(clean(x["title"]))
    own = T.non_empty(F.transform(x["heading_path"], clean))
    path = F.when(F.size(own) > 0, F.concat(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.array(T.strip_numbering(F.element_at(own, -1))))).otherwise(F.array(question))
    return question, path


def faqs(pages: DataFrame) -> DataFrame:
    s = pages.select("*", F.posexplode("accordions").alias("i", "s"))
    question, path = _faq(F.col("s"))
    return s.select(*_doc(3, F.col("i"), _id("faq", F.col("i") + 1), path, F.col("s.content"), "faq", False, question=question))


def tabs(pages: DataFrame) -> DataFrame:
    t = pages.select("*", F.posexplode("tabs").alias("t", "tab"))
    name = T.first_of(clean(F.col("tab.title")), F.concat(F.lit("Tab "), (F.col("t") + 1).cast("string")))
    t = t.withColumn("tab_title", name)
    first = T.numbered(F.concat(F.lit("fst_"), F.col("id"), F.lit("_tab")), "_", F.col("t") + 1, 3)
    item = lambda step, i: F.col("t") * 4_000_000 + step * 1_000_000 + i
    own = {"tab_title": F.col("tab_title")}
    number = lambda part: T.numbered(F.concat(first, F.lit(f"_{part}")), "_", F.col("i") + 1, 3)
    s = t.select("*", F.posexplode("tab.sections").alias("i", "s"))
    path = F.when(F.size(F.coalesce("s.heading_path", _texts())) > 0, F.col("s.heading_path")).otherwise(F.array("tab_title"))
    parts = [s.select(*_doc(4, item(0, F.col("i")), number("section"), path, F.array_join(T.non_empty(F.transform("s.content", clean)), "\n\n"), "tab_section", **own))]
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    plain = t.filter(empty("tab.sections") & empty("tab.accordions") & empty("tab.tables"))
    parts.append(plain.select(*_doc(4, item(0, F.lit(0)), first, F.array("tab_title"), F.col("tab.content"), "tab_section", **own)))
    f = t.select("*", F.posexplode("tab.accordions").alias("i", "s"))
    question, below = _faq(F.col("s"))
    parts.append(f.select(*_doc(4, item(1, F.col("i")), number("faq"), F.concat(F.array("tab_title"), below), F.col("s.content"), "faq", False, question=question, **own)))
    m = t.select("*", F.posexplode("tab.tables").alias("i", "s"))
    text, heading, notes = _table(F.col("s"))
    parts.append(m.select(*_doc(4, item(2, F.col("i")), number("table"), F.array(F.col("tab_title"), heading), text, "table", False, table_caption=F.col("s.caption"), table_notes=notes, **own)))
    p = t.select("*", F.posexplode("tab.location_directory.locations").alias("i", "s"))
    lines = F.concat_ws("\n", *[F.when(clean(F.col(f"s.{field}")) != "", F.concat(F.lit(f"{label}: "), clean(F.col(f"s.{field}")))) for label, field in LOCATION_FIELDS])
    parts.append(p.select(*_doc(4, item(3, F.col("i")), number("location"), F.array(F.col("tab_title"), F.coalesce("s.location_name", F.lit("Location"))), lines, "location", False, map_url=F.col("s.map_url"), **own)))
    return reduce(DataFrame.union, parts)


def coverage(pages: DataFrame) -> DataFrame:
    """(page_id, cover): what the structured parts say, in the comparison form, alone and behind its title."""
    both = lambda a, b, joint: F.when((clean(a) != "") & (clean(b) != ""), F.concat(clean(a), F.lit(joint), clean(b)))
    empty = F.array().cast("array<string>")
    each = lambda items, fn: F.coalesce(F.flatten(F.transform(items, fn)), empty)
    notes = lambda t: F.coalesce(t["notes"], empty)
    everything = F.concat(
        each("registration_details.subsections", lambda s: F.concat(F.array(s["content"], both(s["title"], s["content"], " ")), each(s["items"], lambda x: F.array(x["content"], both(x["label"], x["content"], ": "))))),
        each("itineraries", lambda s: F.array(s["description"], both(s["title"], s["description"], " "))),
        each("tables", notes),
        each("accordions", lambda s: F.array(s["content"], both(s["title"], s["content"], " "))),
        each("tabs", lambda t: F.concat(F.array(t["content"]), each(t["accordions"], lambda a: F.array(a["content"])), each(t["tables"], notes))),
    )
    return pages.select(F.col("id").alias("page_id"), F.explode(everything).alias("cover")).select("page_id", T.comparison(F.col("cover")).alias("cover")).filter("cover <> ''").distinct()


def residual(pages: DataFrame) -> DataFrame:
    """Documents of the paragraphs that no structured part covers; runs of notices and of other paragraphs apart, numbered together."""
    s = pages.select("*", F.posexplode("sections").alias("si", "s"))
    rows = s.select("id", "si", F.posexplode(T.non_empty(F.transform("s.content", clean))).alias("pi", "paragraph")).withColumn("key", T.comparison(F.col("paragraph")))
    covers = coverage(pages).withColumnRenamed("page_id", "id").alias("c")
    # by page, so no paragraph meets more than its own page's parts
    inside = (F.col("key") == F.col("cover")) | ((F.length("cover") >= GUARD) & F.contains("key", "cover")) | ((F.length("key") >= GUARD) & F.contains("cover", "key"))
    left = rows.alias("r").join(covers, (F.col("r.id") == F.col("c.id")) & inside, "left_anti").filter("key <> ''")
    marked = sections.runs(left.withColumn("notice", F.lower("paragraph").rlike(NOTICE)), ["id", "si"], "pi", F.col("notice"))
    grouped = marked.groupBy("id", "si", "run").agg(F.max("notice").alias("notice"), sections.joined_in_order(F.col("paragraph"), F.col("pi"), "\n\n").alias("body"))
    grouped = grouped.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("si", "run")))
    d = s.drop("sections").join(grouped, ["id", "si"])
    title, heading = clean(F.coalesce("title", "name", F.lit(""))), clean(F.col("s.heading"))
    overview = (heading == "") | (T.comparison(heading) == T.comparison(title))
    own = T.non_empty(F.transform("s.heading_path", clean))
    path = F.when(F.col("notice"), F.array(F.lit("Service Notice"))).when(overview, F.array(F.lit("Overview"))).when(F.size(own) > 0, own).otherwise(F.array(heading))
    kind = F.when(F.col("notice"), "service_notice").when(overview, "overview").otherwise("section")
    doc_id = F.when(F.col("notice"), _id("notice", F.col("n"))).otherwise(_id("section", F.col("n")))
    made = d.select(*_doc(5, F.col("n"), doc_id, path, F.col("body"), kind, True, time_sensitive=F.when(F.col("notice"), F.lit(True))))
    return made.withColumn("related", F.col("content_type") != "service_notice")


def assets(pages: DataFrame) -> DataFrame:
    """The image registry: one row for each page and address, with the text of itinerary cards over that of the page around it."""
    images = pages.select(F.col("id").alias("page_id"), F.posexplode("images").alias("i", "m")).select("page_id", "i", clean(F.col("m.url")).alias("url"), clean(F.col("m.alt")).alias("alt"), clean(F.col("m.nearby_heading")).alias("title"), clean(F.col("m.nearby_text")).alias("nearby_text"))
    images = dedup.first_seen(images.filter("url <> ''"), ["page_id", "url"], "i")
    cards = pages.select(F.col("id").alias("page_id"), F.posexplode("itineraries").alias("i", "m")).select("page_id", "i", clean(F.col("m.image.url")).alias("url"), clean(F.col("m.image.alt")).alias("alt"), clean(F.col("m.title")).alias("title"), clean(F.col("m.description")).alias("nearby_text"))
    cards = dedup.last_seen(cards.filter("url <> ''"), ["page_id", "url"], "i")
    g, c = images.alias("g"), cards.alias("c")
    both = g.join(c, (F.col("g.page_id") == F.col("c.page_id")) & (F.col("g.url") == F.col("c.url")), "full_outer")
    over = lambda name: F.coalesce(F.nullif(F.col(f"c.{name}"), F.lit("")), F.col(f"g.{name}"), F.lit("")).alias(name)
    roles = F.array_compact(F.array(F.when(F.col("g.url").isNotNull(), "page_image"), F.when(F.col("c.url").isNotNull(), "itinerary_image")))
    merged = both.select(F.coalesce("g.page_id", "c.page_id").alias("page_id"), F.coalesce("g.url", "c.url").alias("url"), over("alt"), over("title"), over("nearby_text"), roles.alias("roles"), F.coalesce(F.col("g.i"), F.col("c.i") + 1_000_000).alias("i"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("i", "url"))
    return merged.withColumn("asset_id", T.numbered(F.concat(F.lit("fst_"), "page_id", F.lit("_image")), "_", n, 3)).drop("i")


def with_assets(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """asset_ids: the document's own image, or those whose surrounding text and the document's hold one another."""
    d, a = docs.alias("d"), registry.select("page_id", "asset_id", "url", "nearby_text").alias("a")
    key, near = T.comparison(F.col("d.content")), T.comparison(F.col("a.nearby_text"))
    own = F.col("d.asset_url") == F.col("a.url")
    found = F.col("d.related") & (near != "") & (F.contains(key, near) | F.contains(near, key))
    hits = d.join(a, (F.col("d.page_id") == F.col("a.page_id")) & (F.coalesce(own, F.lit(False)) | found)).groupBy("d.page_id", "d.doc_id").agg(F.array_sort(F.collect_set("a.asset_id")).alias("asset_ids"))
    return docs.join(hits, ["page_id", "doc_id"], "left").withColumn("asset_ids", F.coalesce("asset_ids", _texts()))


def curate(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical documents, image registry) of tour pages."""
    registry = assets(pages)
    made = reduce(DataFrame.union, [registration(pages), itineraries(pages), tables(pages), faqs(pages), tabs(pages), residual(pages)]).filter("content <> ''")
    whole = with_assets(made, registry)
    weights = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    priority = F.coalesce(weights[F.col("content_type")], F.lit(0)) + F.when(F.col("page_id") != LANDING, 5).otherwise(0)
    best = dedup.best_by_priority(whole.withColumn("seq", F.struct("page_id", "branch", "item")), T.comparison(F.col("content")), priority, "seq")
    kind = F.to_json(F.struct("page_id", "page_type", "content_type", "asset_ids"))
    metadata = F.when(F.col("extra") == "{}", kind).otherwise(F.concat(F.substring(kind, F.lit(1), F.length(kind) - 1), F.lit(","), F.expr("substring(extra, 2)")))
    docs = best.orderBy("position").select("doc_id", F.lit("Changi Airport").alias("source"), F.lit("web").alias("source_type"), "title", "heading_path", "content", "url", F.lit(None).cast("int").alias("page"), metadata.alias("metadata"))
    return docs, registry
