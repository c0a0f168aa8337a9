"""Plans of requests: normalising, tool dependencies, missing fields, and a rule planner that stands in for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..functions.times import valid_date
from .dedup import first_seen

#: How missing fields are named to people.
LABELS = {
    "passport_country": "passport / nationality",
    "arrival_flight": "arrival flight number",
    "arrival_date": "arrival date",
    "departure_flight": "departure flight number",
    "departure_date": "departure date",
}
FLAGS = ("needs_arrival_flight_lookup", "needs_departure_flight_lookup", "needs_transit_calculation", "needs_fst_operational_check")
PLAN = "request_id BIGINT, passport_country STRING, arrival_flight STRING, arrival_date STRING, departure_flight STRING, departure_date STRING, needs_arrival_flight_lookup BOOLEAN, needs_departure_flight_lookup BOOLEAN, needs_transit_calculation BOOLEAN, needs_fst_operational_check BOOLEAN, missing_fields ARRAY<STRING>"


def flight_number(text: Column) -> Column:
    return F.nullif(F.upper(F.trim(F.replace(text, F.lit(" "), F.lit("")))), F.lit(""))


def normalised(plans: DataFrame) -> DataFrame:
    """Flight numbers in upper case without spaces; dates that aren't dates become null."""
    out = plans
    for side in ("arrival", "departure"):
        out = out.withColumn(f"{side}_flight", flight_number(F.col(f"{side}_flight"))).withColumn(f"{side}_date", valid_date(F.col(f"{side}_date")).cast("string"))
    return out


def with_dependencies(plans: DataFrame) -> DataFrame:
    """A check of tours needs transit, and transit both flights."""
    tours = F.col("needs_fst_operational_check")
    transit = F.col("needs_transit_calculation") | tours
    return plans.withColumns({
        "needs_transit_calculation": transit,
        "needs_arrival_flight_lookup": F.col("needs_arrival_flight_lookup") | transit,
        "needs_departure_flight_lookup": F.col("needs_departure_flight_lookup") | transit,
    })


def with_missing(plans: DataFrame) -> DataFrame:
    """missing_fields: those there, then what the lookups need and haven't got, each once."""
    gaps = []
    for side in ("arrival", "departure"):
        for field in ("flight", "date"):
            name = f"{side}_{field}"
            gaps.append(F.when(F.col(f"needs_{side}_flight_lookup") & F.coalesce(F.col(name) == "", F.lit(True)), F.lit(name)))
    listed = F.coalesce("missing_fields", F.array().cast("array<string>"))
    return plans.withColumn("missing_fields", F.array_distinct(F.concat(listed, F.array_compact(F.array(*gaps)))))


def missing_text(fields: Column) -> Column:
    """A bullet for each missing field, by its label or its name with spaces."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.array_join(F.transform(fields, lambda f: F.concat(F.lit("- "), F.coalesce(labels[f], F.replace(f, F.lit("_"), F.lit(" "))))), "\n")


def distinct_questions(questions: DataFrame) -> DataFrame:
    """(request_id, pos, topic, query): queries with white space collapsed, the first of each topic and wording in any case."""
    clean = questions.withColumn("query", collapse(F.col("query"))).filter("query <> ''").withColumn("_q", F.lower("query"))
    return first_seen(clean, ["request_id", "topic", "_q"], "pos").drop("_q")


def plan_by_rules(requests: DataFrame) -> DataFrame:
    """A plan for each (request_id, text): flight numbers, dates and wanted tools by patterns. Stands in for a model that plans."""
    text = F.col("text")
    flights = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]{2}[0-9]{2,4}|[A-Z]{2} [0-9]{2,4})\b"), 1)
    dates = F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1)
    at = lambda items, n: F.try_element_at(items, F.lit(n))
    tours, transit = text.rlike("(?i)tour"), text.rlike("(?i)transit|layover|between flights")
    plans = requests.select(
        "request_id", F.nullif(F.regexp_extract(text, r"(?i)\b([a-z]+) passport", 1), F.lit("")).alias("passport_country"),
        at(flights, 1).alias("arrival_flight"), at(dates, 1).alias("arrival_date"), at(flights, 2).alias("departure_flight"), F.coalesce(at(dates, 2), at(dates, 1)).alias("departure_date"),
        (F.size(flights) > 0).alias("needs_arrival_flight_lookup"), (F.size(flights) > 1).alias("needs_departure_flight_lookup"), transit.alias("needs_transit_calculation"), tours.alias("needs_fst_operational_check"),
        F.array().cast("array<string>").alias("missing_fields"),
    )
    return with_missing(with_dependencies(normalised(plans)))
