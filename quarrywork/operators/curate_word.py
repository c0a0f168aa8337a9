"""Word files to canonical documents: blocks under headings, as windows over a file's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import sections

#: Headings of known level, by their key.
HEADING_LEVELS = {
    "what counts as an offence?": 1,
    "bringing in prohibited or controlled goods": 1,
    "bringing in contraband cigarettes": 1,
    "breaching the three-quarter tank rule": 1,
    "appeals": 1,
    "reminder": 1,
    "not declaring or making an incorrect declaration": 2,
    "composition amounts for checkpoints offences": 2,
    "prohibited goods": 2,
    "controlled goods": 2,
    "composition amounts for three-quarter tank offences": 2,
}
SHARED_TOPIC = {"bringing in prohibited or controlled goods": "controlled_prohibited_goods"}
LONGEST_HEADING = 100


def heading_key(text: Column) -> Column:
    return F.lower(T.collapse(text))


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def curate(files: DataFrame, default_title: str = "Travel Rules and Penalties", source: str = "Singapore Customs") -> DataFrame:
    """Canonical documents of files (source_file, blocks): the first block is the title, each section with content a document."""
    title = F.coalesce(T.strip(F.col("blocks")[0]["text"]), F.lit(default_title))
    blocks = files.filter(F.size("blocks") > 0).select("source_file", title.alias("document_title"), F.posexplode(F.slice("blocks", 2, F.size("blocks"))).alias("pos", "b")).select("source_file", "document_title", "pos", "b.*")
    body = T.strip(F.coalesce("text", F.lit("")))
    known = _lookup(HEADING_LEVELS, heading_key(F.col("text")))
    bold = F.coalesce(F.col("formatting.mostly_bold"), F.lit(False)) & (F.char_length(body) <= LONGEST_HEADING) & ~body.endswith(".")
    is_heading = (F.col("type") == "paragraph") & (body != "") & (known.isNotNull() | bold)
    # a paragraph without text or a table between two headings breaks their neighbourhood only if it is a block of the file
    leveled = sections.heading_levels(blocks, ["source_file"], "pos", F.coalesce(is_heading, F.lit(False)), known)
    placed = sections.under_headings(leveled.withColumn("heading", body), ["source_file"], "pos", "heading")
    indent = F.repeat(F.lit("  "), F.coalesce(F.col("list.level"), F.lit(0)))
    paragraph = F.when(F.coalesce(F.col("list.is_list_item"), F.lit(False)) & (body != ""), F.concat(indent, F.lit("- "), body)).otherwise(body)
    content = F.when(F.col("type") == "table", T.records_text(F.col("rows"))).when(F.col("type") == "paragraph", paragraph)
    rows = placed.withColumn("part", F.when(F.col("level").isNull(), content)).withColumn("links", F.when(F.col("level").isNull(), F.col("hyperlinks")))
    keys = ["source_file", "document_title", "section"]
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("links") > 0, F.struct("pos", "links")))), lambda x: x["links"]))
    grouped = rows.groupBy(*keys).agg(F.max("h1").alias("h1"), F.max_by("h2", "pos").alias("h2"), sections.joined_in_order(F.col("part"), F.col("pos"), "\n\n").alias("body"), T.distinct_links(listed).alias("links"))
    kept = grouped.filter("body <> ''").withColumn("n", F.row_number().over(Window.partitionBy("source_file").orderBy("section")))
    name = T.first_of(F.col("h2"), F.col("h1"), F.lit("Overview"))
    topic = F.coalesce(_lookup(SHARED_TOPIC, heading_key(F.col("h1"))), F.replace(T.slug(T.first_of(F.col("h1"), F.col("h2"), F.lit("overview")), "-", "section"), F.lit("-"), F.lit("_")))
    metadata = F.to_json(F.struct("source_file", "document_title", F.col("n").alias("section_index"), "h1", "h2", topic.alias("topic"), F.lit("rules").alias("content_role"), "links"))
    return kept.select(
        F.concat(F.lit("customs-word-"), F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("-"), T.slug(name, "-", "section")).alias("doc_id"),
        F.lit(source).alias("source"), F.lit("word").alias("source_type"), name.alias("title"), F.concat_ws(" > ", "document_title", "h1", "h2").alias("heading_path"),
        F.concat_ws("\n\n", T.strip(F.col("body")), T.reference_block(F.col("links"))).alias("content"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("page"), metadata.alias("metadata"),
    )
