"""Visa pages to canonical documents: an index, details of countries and the free transit facility, each a union of projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PAGE_TYPES = ("visa_index", "visa_detail", "vftf")
#: Fixed value: the line above a list of countries.
LISTED = "Countries and places listed by ICA as requiring an entry visa:\n"
#: Words of a group's title and the footnote that explains them, in the order they are looked up.
FOOTNOTES_BY_TITLE = (("prc", "2"), ("cis", "1"))

clean = T.tidy_punctuation


def _row(order: tuple[int, Column], doc_id: Column, title: Column, last: Column, content: Column, **metadata: Column) -> list[Column]:
    path = F.array_join(T.non_empty(F.array(F.lit("ICA"), clean(F.col("title")), last)), " > ")
    meta = F.to_json(F.struct(*[v.alias(k) for k, v in metadata.items()]))
    return [
        F.lit(order[0]).alias("branch"), order[1].cast("int").alias("item"), F.col("id").alias("page_id"), doc_id.alias("doc_id"), F.lit("ICA").alias("source"), F.lit("web").alias("source_type"),
        title.alias("title"), path.alias("heading_path"), content.alias("content"), clean(F.col("url")).alias("url"), F.lit(None).cast("int").alias("page"), meta.alias("metadata"),
    ]


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def _headed(head: str, items: Column, joined: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(head), joined))


def section_text(section: Column) -> Column:
    """A section's content, notes and actions in one text."""
    notes = T.non_empty(F.transform(F.coalesce(section["notes"], F.array().cast("array<string>")), clean))
    lines = F.transform(section["actions"], lambda a: F.when(clean(a["text"]) == "", None).when(clean(a["url"]) == "", F.concat(F.lit("- "), clean(a["text"]))).otherwise(F.concat(F.lit("- ["), clean(a["text"]), F.lit("]("), clean(a["url"]), F.lit(")"))))
    actions = F.coalesce(F.array_compact(lines), F.array().cast("array<string>"))
    return F.concat_ws("\n\n", F.nullif(clean(section["content"]), F.lit("")), _headed("Additional notes:\n", notes, F.array_join(notes, "\n\n")), _headed("Actions:\n", actions, F.array_join(actions, "\n")))


def index_documents(pages: DataFrame) -> DataFrame:
    p = pages.filter("page_type = 'visa_index'")
    kind = lambda name: {"content_type": F.lit(name), "page_type": F.lit("visa_index")}
    overview = p.select(*_row((0, F.lit(0)), F.concat("id", F.lit("_overview")), F.lit("Singapore Entry Visa Overview"), F.lit("Overview"), clean(F.col("overview")), **kind("visa_overview")))
    s = p.select("*", F.posexplode("sections").alias("i", "s"))
    name = clean(F.col("s.title"))
    parts = s.select(*_row((1, F.col("i")), T.numbered(F.concat("id", F.lit("_"), T.slug(name, "_")), "_", F.col("i") + 1, 2), name, name, clean(F.col("s.content")), **kind("visa_policy_section"), section=name))
    names = T.non_empty(F.transform("country_list.countries", lambda c: clean(c["name"])))
    text = F.concat_ws("\n\n", F.nullif(clean(F.col("country_list.description")), F.lit("")), F.when(F.size(names) > 0, F.concat(F.lit(LISTED), _bullets(names))))
    head = T.first_of(clean(F.col("country_list.title")), F.lit("Travel Documents by Countries and Places"))
    countries = p.select(*_row((2, F.lit(0)), F.concat("id", F.lit("_travel_documents_countries_places")), head, head, text, **kind("visa_country_list"), country_count=F.greatest(F.size(names), F.lit(0))))
    return overview.union(parts).union(countries)


def detail_documents(pages: DataFrame) -> DataFrame:
    p = pages.filter("page_type = 'visa_detail'").withColumn("land", clean(F.col("country")))
    first = F.concat(F.lit("ica_"), T.slug(F.col("land"), "_"), F.lit("_"))
    kind = lambda name: {"content_type": F.lit(name), "page_type": F.lit("visa_detail"), "country": F.col("land")}
    required = F.coalesce(F.col("visa_requirement.required"), F.lit(False))
    need = p.select(*_row((0, F.lit(0)), F.concat(first, F.lit("visa_requirement")), F.concat("land", F.lit(" Visa Requirement")), F.lit("Visa Requirement"), clean(F.col("visa_requirement.content")), **kind("visa_requirement"), visa_required=required))
    s = p.select("*", F.posexplode("sections").alias("i", "s")).filter(clean(F.col("s.title")) != "")
    name = clean(F.col("s.title"))
    parts = s.select(*_row((1, F.col("i")), F.concat(first, T.slug(name, "_")), F.concat("land", F.lit(" - "), name), name, section_text(F.col("s")), **kind("visa_application_section"), section=name, section_index=F.col("i") + 1))
    return need.union(parts)


def transit_documents(pages: DataFrame) -> DataFrame:
    p = pages.filter("page_type = 'vftf'")
    sound = F.filter(F.transform("footnotes", lambda f: F.struct(clean(f["number"]).alias("number"), clean(f["content"]).alias("content"))), lambda f: (f["number"] != "") & (f["content"] != ""))
    # the last of several footnotes of a number counts
    p = p.withColumn("notes", F.coalesce(F.aggregate(sound, F.create_map().cast("map<string,string>"), lambda m, f: F.map_concat(F.map_filter(m, lambda k, _: k != f["number"]), F.create_map(f["number"], f["content"]))), F.create_map().cast("map<string,string>")))
    kind = lambda name: {"content_type": F.lit(name), "page_type": F.lit("vftf")}
    overview = p.select(*_row((0, F.lit(0)), F.concat("id", F.lit("_overview")), F.lit("Visa Free Transit Facility Overview"), F.lit("Overview"), clean(F.col("overview")), **kind("vftf_overview")))
    g = p.select("*", F.posexplode("eligibility_groups").alias("i", "g")).filter(clean(F.col("g.title")) != "")
    name, needs = clean(F.col("g.title")), T.non_empty(F.transform("g.requirements", clean))
    whole = F.concat_ws("\n", name, clean(F.col("g.content")), F.array_join(needs, "\n"))
    by_title = [F.when(F.contains(F.lower(name), F.lit(word)), F.lit(n)) for word, n in FOOTNOTES_BY_TITLE]
    refs = F.filter(F.array_distinct(F.concat(F.regexp_extract_all(whole, F.lit(r"\[(\d+)\]"), 1), F.array_compact(F.array(*by_title)))), lambda n: F.map_contains_key("notes", n))
    g = g.withColumn("refs", refs)
    lines, notes = F.coalesce(needs, F.array().cast("array<string>")), F.transform("refs", lambda n: F.col("notes")[n])
    text = F.concat_ws("\n\n", F.nullif(clean(F.col("g.content")), F.lit("")), _headed("Requirements:\n", lines, _bullets(lines)), _headed("Relevant ICA notes:\n", notes, F.array_join(notes, "\n\n")))
    parts = g.select(*_row((1, F.col("i")), F.concat("id", F.lit("_"), T.slug(name, "_")), name, name, text, **kind("vftf_eligibility"), eligibility_group=name, footnote_refs=F.array_join("refs", ","), group_index=F.col("i") + 1))
    return overview.union(parts)


def curate(pages: DataFrame) -> DataFrame:
    """Canonical documents of pages of the three types, in order of page, branch and item; other pages give none."""
    found = reduce(DataFrame.union, [index_documents(pages), detail_documents(pages), transit_documents(pages)])
    return found.filter("content <> ''").orderBy("page_id", "branch", "item").drop("page_id", "branch", "item")
