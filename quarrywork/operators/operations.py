"""Flights, transit and tour sessions: lookups and eligibility with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import effective, hours_between

#: Reasons in the order they are given.
REASONS = ("Session is not open.", "No remaining slots.", "Arrival is after the reporting deadline.", "Departure flight is too early for this tour session.")


def find_flight(flights: DataFrame, number: Column, date: Column, direction: Column) -> DataFrame:
    """The flight with this number (any case), date and direction; the one with the least id of several."""
    same = (F.upper("flight_number") == F.upper(number)) & (F.col("flight_date") == date) & (F.upper("direction") == F.upper(direction))
    return flights.filter(same).orderBy("id").limit(1)


def sessions_on(sessions: DataFrame, date: Column) -> DataFrame:
    return sessions.filter(F.col("service_date") == date).orderBy("start_datetime", "id")


def find_session(sessions: DataFrame, code: str) -> DataFrame:
    return sessions.filter(F.col("session_code") == code).orderBy("id").limit(1)


def reasons(status: Column, slots: Column, arrival: Column, deadline: Column, departure: Column, required: Column) -> Column:
    """Why a session is out, in order; empty when it is eligible. A time that just meets its bound is in time."""
    failed = (F.upper(status) != "OPEN", slots <= 0, arrival > deadline, departure < required)
    return F.array_compact(F.array(*[F.when(f, F.lit(r)) for f, r in zip(failed, REASONS)]))


def journeys(flights: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, arrival_flight, arrival_date, departure_flight, departure_date) with both times and the transit hours.

    A request one of whose flights is missing keeps nulls, with error saying which.
    """
    slot = lambda way: flights.filter(F.upper("direction") == way).select(F.upper("flight_number").alias("n"), F.col("flight_date").alias("d"), F.struct("id", effective(F.col("estimated_datetime"), F.col("scheduled_datetime")).alias("at")).alias("f")).groupBy("n", "d").agg(F.min("f").alias("f"))
    a, d = slot("ARRIVAL").alias("a"), slot("DEPARTURE").alias("b")
    out = requests.alias("q").join(a, (F.upper("q.arrival_flight") == F.col("a.n")) & (F.col("q.arrival_date") == F.col("a.d")), "left")
    out = out.join(d, (F.upper("q.departure_flight") == F.col("b.n")) & (F.col("q.departure_date") == F.col("b.d")), "left")
    out = out.select("q.*", F.col("a.f.at").alias("arrival_at"), F.col("b.f.at").alias("departure_at"))
    error = F.when(F.col("arrival_at").isNull(), F.lit("Arrival flight not found.")).when(F.col("departure_at").isNull(), F.lit("Departure flight not found.")).when(F.col("departure_at") < F.col("arrival_at"), F.lit("Departure occurs before arrival."))
    return out.withColumn("transit_hours", hours_between(F.col("arrival_at"), F.col("departure_at"))).withColumn("error", error)


def evaluate(flights: DataFrame, sessions: DataFrame, requests: DataFrame, least_hours: float | None = None, most_hours: float | None = None) -> DataFrame:
    """One row for each request and session of its arrival date, with reasons and eligible. Bounds on the transit are off unless given."""
    trips = journeys(flights, requests).filter("error IS NULL")
    if least_hours is not None:
        trips = trips.filter(F.col("transit_hours") >= least_hours)
    if most_hours is not None:
        trips = trips.filter(F.col("transit_hours") <= most_hours)
    why = reasons(F.col("status"), F.col("remaining_slots"), F.col("arrival_at"), F.col("reporting_deadline"), F.col("departure_at"), F.col("required_departure_after"))
    judged = trips.join(sessions, F.col("arrival_date") == F.col("service_date")).withColumn("reasons", why)
    return judged.withColumn("eligible", F.size("reasons") == 0)


# ---- tools: results with success and error, for callers that want an answer and no exception


def lookup_tool(found: DataFrame, key: Column, message: str, asked: tuple[str, ...] = ()) -> DataFrame:
    """(*asked, success, error, data) of lookups: asked names the columns of the question; data is a struct of the others, null where key is."""
    data = F.struct(*(c for c in found.columns if c not in asked))
    return found.select(*asked, key.isNotNull().alias("success"), F.when(key.isNull(), F.lit(message)).alias("error"), F.when(key.isNotNull(), data).alias("data"))


def session_count(sessions: DataFrame, date: Column) -> DataFrame:
    return sessions_on(sessions, date).agg(F.count("*").alias("session_count"))


def transit_allowed(hours: Column, least: float = 5.5, most: float = 24.0) -> Column:
    return hours.between(least, most)


#: Fixed value: from so few places on, the number is shown with emphasis.
FEW_SLOTS = 3


def offers(sessions: DataFrame) -> DataFrame:
    """sessions with few_slots (to be emphasised) and bookable, for showing them."""
    left = F.coalesce("remaining_slots", F.lit(0))
    return sessions.withColumns({"few_slots": left <= FEW_SLOTS, "bookable": left > 0})
