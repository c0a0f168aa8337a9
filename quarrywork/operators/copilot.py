"""From questions to prepared answers, many at a time: plan, check operations, retrieve evidence, render, answer.

Models sit behind two hooks, plan and answer, functions of DataFrames and
columns; the stand-ins need no model. What came from a stand-in says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..functions.walk import leaves
from . import operations, requests, retrieval, sections

#: Keys of addresses and labels in metadata, prefixes of citations, and sentences.
URL_KEYS, LABEL_KEYS = ("url", "href", "link"), ("text", "label", "title", "name")
PREFIXES = {"visa": "VISA", "fst": "FST", "customs": "CUSTOMS"}
DEFAULT_LABEL = "Official resource"
MISSING = "I need a little more information before I can complete this check:\n\n"
NOTHING_ROUTED = "I could not identify a travel, compliance, policy, or operational check required for this request."
NO_OPERATIONS = "No operational database lookup or deterministic calculation was required."


def document_links(documents: DataFrame, base: str = "") -> DataFrame:
    """(doc_id, n, label, url): the page's address, then those in metadata, then markdown, HTML and bare ones of the content; the first of each address."""
    own = documents.select("doc_id", F.lit(0).alias("step"), F.lit(0).alias("at"), F.coalesce("title", F.lit("")).alias("label"), "url")
    found = leaves(documents.select("doc_id", "metadata"), "metadata").withColumn("key", F.element_at(F.split("path", r"\."), -1)).withColumn("parent", F.regexp_replace("path", r"\.?[^.]*$", ""))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(LABEL_KEYS) for x in (k, i)])
    labels = found.filter(F.col("key").isin(*LABEL_KEYS)).groupBy("doc_id", "parent").agg(F.min_by("value", rank[F.col("key")]).alias("label"))
    order = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("path"))
    given = found.filter(F.col("key").isin(*URL_KEYS)).join(labels, ["doc_id", "parent"], "left").select("doc_id", F.lit(1).alias("step"), order.alias("at"), F.coalesce("label", F.lit("")).alias("label"), F.col("value").alias("url"))
    each = lambda pattern, label, url: F.zip_with(F.regexp_extract_all("content", F.lit(pattern), label), F.regexp_extract_all("content", F.lit(pattern), url), lambda a, b: F.struct(a.alias("label"), b.alias("url")))
    bare = F.transform(F.regexp_extract_all("content", F.lit(f"({T.RAW_URL})"), 1), lambda u: F.struct(F.lit("").alias("label"), u.alias("url")))
    texts = documents.select("doc_id", F.posexplode(F.concat(each(T.MARKDOWN_LINK, 1, 2), each(T.HTML_LINK, 2, 1), bare)).alias("at", "l")).select("doc_id", F.lit(2).alias("step"), "at", "l.label", "l.url")
    rows = own.union(given).union(texts).withColumn("url", urls.resource(F.col("url"), base)).filter("url IS NOT NULL")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "url").orderBy("step", "at"))).filter("_n = 1")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("step", "at"))
    return first.select("doc_id", n.alias("n"), T.first_of(T.collapse(F.col("label")), F.lit(DEFAULT_LABEL)).alias("label"), "url")


def candidate_text(candidates: DataFrame) -> DataFrame:
    """(query_id, text): a query's candidates (doc, source, title, heading_path, content, rank) as numbered blocks for a scorer."""
    block = F.concat_ws("\n", F.concat(F.lit("CANDIDATE "), F.col("rank").cast("string")), *[F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in (("chunk_id", "doc"), ("source", "source"), ("title", "title"), ("heading", "heading_path"))], F.lit("content:"), "content")
    return candidates.groupBy("query_id").agg(sections.joined_in_order(block, F.col("rank"), "\n\n---\n\n").alias("text"))


def _shown(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def operational_text(trips: DataFrame, judged: DataFrame) -> DataFrame:
    """(request_id, operations): flights, transit and feasible sessions of each trip as text under one citation."""
    tour = F.concat_ws("\n", F.concat(F.lit("Tour: "), "tour_name"), F.concat(F.lit("Date: "), F.col("service_date").cast("string")), F.concat(F.lit("Start: "), _shown(F.col("start_datetime"))), F.concat(F.lit("End: "), _shown(F.col("end_datetime"))), F.concat(F.lit("Remaining slots: "), F.col("remaining_slots").cast("string")))
    feasible = judged.filter("eligible").groupBy("request_id").agg(sections.joined_in_order(tour, F.struct("start_datetime", "session_code"), "\n\n").alias("tours"), F.count("*").alias("n"))
    flight = lambda side: F.when(F.col(f"{side}_at").isNotNull(), F.concat(F.lit(f"{side.capitalize()} flight:\n- Flight: "), F.col(f"{side}_flight"), F.lit("\n- Date/time: "), _shown(F.col(f"{side}_at"))))
    transit = F.when(F.col("transit_hours").isNotNull(), F.concat(F.lit("Calculated transit duration: "), F.col("transit_hours").cast("string"), F.lit(" hours")))
    checked = F.when(F.col("needs_fst_operational_check"), F.concat(F.lit("Operationally feasible tour session count: "), F.coalesce("n", F.lit(0)).cast("string")))
    text = F.concat_ws("\n\n", F.lit("[OPS1]\nSource: operational tables and fixed rules"), flight("arrival"), flight("departure"), transit, checked, F.when(F.col("needs_fst_operational_check"), F.col("tours")))
    known = F.col("arrival_at").isNotNull() | F.col("departure_at").isNotNull()
    return trips.join(feasible, "request_id", "left").select("request_id", F.when(known, text).otherwise(NO_OPERATIONS).alias("operations"))


def digest(trips: DataFrame, judged: DataFrame) -> DataFrame:
    """(request_id, digest): a few lines on a trip, for the conversation that goes on."""
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("start_datetime", "session_code"))
    good = judged.filter("eligible").withColumn("n", n)
    line = F.concat(F.col("n").cast("string"), F.lit(". "), "tour_name", F.lit(" | "), _shown(F.col("start_datetime")), F.lit(" - "), _shown(F.col("end_datetime")), F.lit(" | "), F.col("remaining_slots").cast("string"), F.lit(" slots left"))
    lines = good.groupBy("request_id").agg(sections.joined_in_order(line, F.col("n"), "\n").alias("lines"))
    flight = lambda side: F.when(F.col(f"{side}_at").isNotNull(), F.concat(F.lit(f"{side.capitalize()}: "), F.col(f"{side}_flight"), F.lit(" | "), _shown(F.col(f"{side}_at"))))
    tours = F.when(F.col("lines").isNull(), F.lit("Eligible FST sessions: none")).otherwise(F.concat(F.lit("Eligible FST sessions:\n"), "lines"))
    return trips.join(lines, "request_id", "left").select("request_id", F.concat_ws("\n", flight("arrival"), flight("departure"), F.concat(F.lit("Transit: "), T.clock(F.col("transit_hours"))), F.when(F.col("needs_fst_operational_check"), tours)).alias("digest"))


def knowledge_text(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(request_id, knowledge): evidence (request_id, topic, pos, rank, doc_id, source, title, ...) under running citations of each topic, with the documents' links."""
    listed = links.groupBy("doc_id").agg(sections.joined_in_order(F.concat(F.lit("- "), "label", F.lit(": "), "url"), F.col("n"), "\n").alias("links"))
    named = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    n = F.row_number().over(Window.partitionBy("request_id", "topic").orderBy("pos", "rank"))
    cited = evidence.withColumn("citation", F.concat(F.coalesce(named[F.col("topic")], F.upper("topic")), n.cast("string"))).join(listed, "doc_id", "left")
    part = lambda label, c: F.concat(F.lit(label), F.nullif(F.col(c).cast("string"), F.lit("")))
    block = F.concat_ws("\n", F.concat(F.lit("["), "citation", F.lit("]")), part("Source: ", "source"), part("Title: ", "title"), part("Rerank score: ", "rerank_score"), part("Heading: ", "heading_path"), part("Page: ", "page"), part("Content:\n", "content"), part("Trusted links supplied by the source:\n", "links"))
    return cited.groupBy("request_id").agg(sections.joined_in_order(block, F.struct("pos", "rank"), "\n\n" + "-" * 36 + "\n\n").alias("knowledge"))


def topic_evidence(evidence: DataFrame, topic: str) -> DataFrame:
    return evidence.filter(F.col("topic") == topic).orderBy("request_id", "pos", "rank")


def traced(evidence: DataFrame, k: int = 3) -> DataFrame:
    """The first k pieces of evidence of each question, for showing how an answer came about."""
    n = F.row_number().over(Window.partitionBy("request_id", "topic", "pos").orderBy("rank"))
    return evidence.withColumn("_n", n).filter(F.col("_n") <= k).drop("_n")


def prepare(asked: DataFrame, flights: DataFrame, session_table: DataFrame, knowledge: DataFrame, retrieve: Callable[[DataFrame], DataFrame], plan: Callable[[DataFrame], DataFrame] = requests.plan_by_rules) -> DataFrame:
    """(request_id, text, missing_fields, direct_answer, operations, digest, knowledge) of requests (request_id, text).

    knowledge: wanted questions (request_id, pos, topic, query). retrieve: cited
    evidence of (query_id, text) questions, from an index. A request that lacks
    fields gets a direct answer and nothing else; so does one that asks for nothing.
    """
    plans = plan(asked)
    ready = plans.filter(F.size("missing_fields") == 0)
    wanted = ready.filter(" OR ".join(requests.FLAGS)).withColumns({c: F.col(c).cast("date") for c in ("arrival_date", "departure_date")})
    trips = operations.journeys(flights, wanted)
    judged = operations.evaluate(flights, session_table, wanted.filter("needs_fst_operational_check"))
    questions = requests.distinct_questions(knowledge.join(ready.select("request_id"), "request_id", "left_semi"))
    key = F.xxhash64("request_id", "pos", "topic")
    found = retrieve(questions.select(key.alias("query_id"), F.col("query").alias("text"))).join(questions.withColumn("query_id", key), "query_id").withColumnRenamed("parent", "doc_id")
    links = document_links(found.select("doc_id", "title", "url", "metadata", "content").dropDuplicates(["doc_id"]))
    out = asked.join(plans.select("request_id", "missing_fields"), "request_id").join(operational_text(trips, judged), "request_id", "left").join(digest(trips, judged), "request_id", "left").join(knowledge_text(found, links), "request_id", "left")
    routed = F.col("operations").isNotNull() | F.col("knowledge").isNotNull() | F.col("_asked").isNotNull()
    out = out.join(questions.select("request_id").distinct().withColumn("_asked", F.lit(True)), "request_id", "left")
    direct = F.when(F.size("missing_fields") > 0, F.concat(F.lit(MISSING), requests.missing_text(F.col("missing_fields")))).when(~routed, F.lit(NOTHING_ROUTED))
    return out.select("request_id", "text", "missing_fields", direct.alias("direct_answer"), F.coalesce("operations", F.lit(NO_OPERATIONS)).alias("operations"), "digest", "knowledge")


def prompt(prepared: DataFrame) -> DataFrame:
    """prepared with prompt: what an answering model is given."""
    return prepared.withColumn("prompt", F.concat_ws("\n\n", F.lit("Answer only from what follows, and cite it."), F.concat(F.lit("Question: "), "text"), "operations", "knowledge"))


def run(prepared: DataFrame, answer: Callable[[Column], Column] | None = None) -> DataFrame:
    """(request_id, answer): the direct answer, else the model's of the prompt; without a model the material itself, marked so."""
    asked = prompt(prepared)
    made = answer(F.col("prompt")) if answer else F.concat_ws("\n\n", F.lit("(No model: the material is given as it is.)"), F.when(F.col("operations") != NO_OPERATIONS, F.col("operations")), F.coalesce("knowledge", F.when(F.col("operations") == NO_OPERATIONS, F.lit(retrieval.NOTHING_FOUND))))
    return asked.select("request_id", F.coalesce("direct_answer", made).alias("answer"))
