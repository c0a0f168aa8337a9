"""A two-column PDF page to canonical documents: numbered anchors cut the columns into sections, lines fall into them by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import joins, sections

#: Titles and columns of the sections, repairs of texts, phrases that the text layer breaks into lines,
#: the lines of a section's printed heading, and lines that are list items.
TITLES = {"01": "Identify Your Goods", "02": "Controlled Goods", "03": "Prohibited Goods", "04": "United Nations Security Council Sanctions", "05": "Obtain Permit", "06": "Clearance of Goods", "07": "Common Questions from AskGov"}
COLUMNS = {"01": "left", "02": "right", "03": "left", "04": "right", "05": "left", "06": "right", "07": "left"}
TEXT_FIXES = {"Declarations are checke d": "Declarations are checked", "Delay s": "Delays"}
PHRASES = (
    ("Allowed to Import with", "Approval"),
    ("Controlled goods are allowed, but only with approval", "from the relevant Competent Authority (CA)."),
    ("Medicines and", "health products"),
    ("Plants and", "animals"),
    ("Telecommunications", "equipment"),
    ("Weapons and", "replicas"),
    ("Counterfeit", "goods"),
    ("Obscene", "publications"),
    ("Certain weapons", "and explosives"),
    ("Endangered", "wildlife products"),
    ("Items banned under", "Singapore Law"),
    ("Some goods, persons, or countries are subject to", "United Nations Security Council (UNSC) Sanctions."),
    ("These restrictions may apply even if goods are", "otherwise allowed."),
    ("When goods", "arrive:"),
    ("Permits and approvals are", "verified"),
    ("Consequences", "of non-", "compliance:"),
    ("Penalties or enforcement", "action"),
    ("How do I know if my goods are controlled or", "prohibited?"),
    ("Self-check using the HS/CA Product Code", "Checker."),
    ("No. Valid permits (including CA’s approval) must be", "obtained prior to importation."),
    ("Goods may be seized and enforcement action", "may be taken."),
)
HEADER_LINES = {
    "01": ("01.", "Identify Your Goods"),
    "02": ("02.", "Controlled Goods"),
    "03": ("03.", "Prohibited Goods"),
    "04": ("04.", "United Nations", "Security Council", "Sanctions"),
    "05": ("05.", "Obtain Permit"),
    "06": ("06.", "Clearance of", "Goods"),
    "07": ("07.", "Common Questions", "from AskGov"),
}
LIST_ITEMS = {
    "01": ("What the goods are", "How they are used", "Where they come from", "Who they are for"),
    "02": ("Medicines and health products", "Food items", "Plants and animals", "Drones", "Telecommunications equipment", "Weapons and replicas"),
    "03": ("Counterfeit goods", "Obscene publications", "Certain weapons and explosives", "Endangered wildlife products", "Items banned under Singapore Law"),
    "04": ("Specific goods", "Named individuals or entities", "Certain countries or regions"),
    "05": ("Obtain relevant CA’s approval", "Prepare required trade documents", "Obtain import permit"),
    "06": ("Declarations are checked", "Permits and approvals are verified", "Goods may be inspected", "Delays", "Seizure of goods", "Penalties or enforcement action"),
}
ABOVE_ANCHOR, BEFORE_NEXT, FOOT, MIDDLE = 0.025, 0.01, 0.95, 0.50


def fixed(text: Column) -> Column:
    clean = T.collapse(text)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in TEXT_FIXES.items() for x in pair])[clean], clean)


def lines_of(files: DataFrame) -> DataFrame:
    """One row per line: file, page, text, x and y of its middle, y of its top, links."""
    pages = files.select("source_file", F.explode("pages").alias("p"))
    lines = pages.select("source_file", F.col("p.page_number").alias("page"), F.posexplode("p.lines").alias("nth", "l"))
    box = F.col("l.bbox_normalized")
    return lines.select("source_file", "page", "nth", fixed(F.col("l.text")).alias("text"), ((box[0] + box[2]) / 2).alias("x"), ((box[1] + box[3]) / 2).alias("y"), box[0].alias("x0"), box[1].alias("y0"), F.col("l.links").alias("links"))


def _column(x: Column) -> Column:
    return F.when(x < MIDDLE, "left").otherwise("right")


def regions(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(file, page, side, section, y_start, y_end) from the anchors 01. to 07., the last line of each; strict: an error on a page that lacks one."""
    number = F.regexp_extract("text", r"^(0[1-7])\.$", 1)
    anchors = lines.withColumn("section", number).filter("section <> ''").groupBy("source_file", "page", "section").agg(F.max_by("y0", "nth").alias("anchor"))
    if strict:
        pages = lines.select("source_file", "page").distinct().join(anchors.groupBy("source_file", "page").agg(F.collect_set("section").alias("found")), ["source_file", "page"], "left")
        missing = F.array_except(F.array(*[F.lit(n) for n in TITLES]), F.coalesce("found", F.array().cast("array<string>")))
        whole = pages.withColumn("ok", F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("Missing section anchors: "), F.array_join(F.array_sort(missing), ", ")))).otherwise(F.lit(True)))
        anchors = anchors.join(whole.filter("ok").select("source_file", "page"), ["source_file", "page"])
    side = F.create_map(*[F.lit(x) for pair in COLUMNS.items() for x in pair])[F.col("section")]
    following = F.lead("anchor").over(Window.partitionBy("source_file", "page", "side").orderBy("section"))
    return anchors.withColumn("side", side).withColumn("y_start", F.greatest(F.lit(0.0), F.col("anchor") - ABOVE_ANCHOR)).withColumn("y_end", F.coalesce(following - BEFORE_NEXT, F.lit(FOOT)))


def merge_phrases(lines: list[dict]) -> list[dict]:
    """Lines of one section in order, with each phrase whose fragments are all there, on lines of their own, as one line at the first's place."""
    for fragments in PHRASES:
        taken: list[int] = []
        for part in fragments:
            key = " ".join(part.split()).casefold()
            at = next((i for i, line in enumerate(lines) if i not in taken and " ".join(line["text"].split()).casefold() == key), None)
            if at is None:
                break
            taken.append(at)
        else:
            joined = " ".join(fragments).replace("non- ", "non-")
            links = list(dict.fromkeys(u for i in taken for u in (lines[i]["links"] or [])))
            first = lines[min(taken)]
            lines = [{**first, "text": joined, "links": links} if i == min(taken) else line for i, line in enumerate(lines) if i == min(taken) or i not in taken]
    return sorted(lines, key=lambda x: (x["y"], x["x"]))


_PLACED = "source_file string, page int, section string, at int, text string, x double, y double, links array<string>"


def placed_lines(files: DataFrame, strict: bool = True) -> DataFrame:
    """Lines in their sections, in reading order, with broken phrases mended."""
    lines = lines_of(files)
    cut = regions(lines, strict).select("source_file", "page", "side", "section", "y_start", "y_end")
    inside = joins.in_region(lines.withColumn("side", _column(F.col("x"))), cut, ["source_file", "page", "side"], "y", "y_start", "y_end", "section", ["source_file", "page", "nth"])
    owned = inside.filter("text <> ''")

    def mend(group):
        import pandas as pd

        rows = group.sort_values(["y", "x"], kind="stable")[["text", "x", "y", "links"]].to_dict("records")
        for r in rows:
            r["links"] = [] if r["links"] is None else list(r["links"])
        out = pd.DataFrame(merge_phrases(rows))
        key = group.iloc[0]
        return out.assign(source_file=key["source_file"], page=key["page"], section=key["section"], at=range(len(out)))[["source_file", "page", "section", "at", "text", "x", "y", "links"]]

    return owned.select("source_file", "page", "section", "text", F.col("x0").alias("x"), F.col("y0").alias("y"), "links").groupBy("source_file", "page", "section").applyInPandas(mend, _PLACED)


def curate(files: DataFrame, document_title: str, strict: bool = True, source: str = "Singapore Customs") -> DataFrame:
    """One canonical document for each section of each page."""
    lines = placed_lines(files, strict)
    key = ["source_file", "page", "section"]
    pairs = lambda table: [(n, v.lower()) for n, values in table.items() for v in values]
    spark = files.sparkSession
    low = F.lower(T.collapse(F.col("text")))
    heads = spark.createDataFrame(pairs(HEADER_LINES), "section string, low string")
    items = spark.createDataFrame(pairs(LIST_ITEMS), "section string, low string").withColumn("listed", F.lit(True))
    body = lines.withColumn("low", low).join(F.broadcast(heads), ["section", "low"], "left_anti").join(F.broadcast(items), ["section", "low"], "left")  # two lists of a few lines
    w = Window.partitionBy(*key).orderBy("at")
    asks = (F.col("section") == "07") & F.col("text").rlike("^Q[1-4]:$")
    # a question takes the two lines behind it, unless it is itself one of those
    marked = body.withColumn("n", F.regexp_extract("text", r"^Q([1-4]):$", 1)).withColumn("q", F.lead("text", 1, "").over(w)).withColumn("a", F.lead("text", 2, "").over(w))
    taken = F.coalesce(F.lag(asks, 1).over(w), F.lit(False)) | F.coalesce(F.lag(asks, 2).over(w), F.lit(False))
    shown = F.when(asks, F.concat(F.lit("Q"), "n", F.lit(": "), "q", F.lit("\nA"), "n", F.lit(": "), "a", F.lit("\n")))
    bullet = F.concat(F.lit("- "), T.strip(F.regexp_replace("text", "^•+", "")))
    shown = F.when(taken & (F.col("section") == "07"), None).otherwise(F.coalesce(shown, F.when((F.col("section") != "07") & F.col("text").startswith("•"), bullet).when((F.col("section") != "07") & F.col("listed"), F.concat(F.lit("- "), "text")).otherwise(F.col("text"))))
    text = marked.withColumn("shown", shown).groupBy(*key).agg(sections.joined_in_order(F.col("shown"), F.col("at"), "\n").alias("content"))
    linked = lines.select(*key, "at", "text", F.posexplode("links").alias("i", "url")).filter("url <> ''").groupBy(*key).agg(T.distinct_links(F.transform(F.array_sort(F.collect_list(F.struct("at", "i", "text", "url"))), lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url")))).alias("links"))
    name = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])[F.col("section")]
    side = F.create_map(*[F.lit(x) for pair in COLUMNS.items() for x in pair])[F.col("section")]
    metadata = F.to_json(F.struct("source_file", F.lit(document_title).alias("document_title"), F.col("section").alias("section_number"), side.alias("layout_column"), F.lit("controlled_prohibited_goods").alias("topic"), F.lit("examples_and_process").alias("content_role"), "links"))
    whole = text.join(linked, key, "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<text:string,url:string>>")))
    return whole.select(
        F.concat(F.lit("customs-pdf-"), "section", F.lit("-"), T.slug(name, "-", "section")).alias("doc_id"), F.lit(source).alias("source"), F.lit("pdf").alias("source_type"), name.alias("title"),
        F.concat(F.lit(f"{document_title} > "), "section", F.lit(" "), name).alias("heading_path"), T.strip(F.col("content")).alias("content"), F.lit(None).cast("string").alias("url"), "page", metadata.alias("metadata"),
    )
