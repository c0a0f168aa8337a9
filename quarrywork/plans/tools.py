"""Tools for callers of SQL: table functions over the operational views, each answering with success and error and never with an exception.

SELECT * FROM lookup_flight('SQ12', DATE'2026-08-20')
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_AT = "coalesce(estimated_datetime, scheduled_datetime)"
_ARRIVES, _LEAVES = "flight_time(arrival_no, arrival_day, 'ARRIVAL')", "flight_time(departure_no, departure_day, 'DEPARTURE')"
#: The hours of transit that make a passenger's case worth a check; a separate tool, the evaluator has no such bounds.
LEAST_HOURS, MOST_HOURS = 5.5, 24.0

TOOLS = {
    "lookup_flight": (
        "flight_no STRING, on_day DATE",
        "success BOOLEAN, error STRING, direction STRING, at TIMESTAMP_NTZ, terminal STRING, status STRING",
        f"SELECT count(*) > 0, CASE WHEN count(*) = 0 THEN 'Flight not found.' END, min_by(direction, id), min_by({_AT}, id), min_by(terminal, id), min_by(status, id) FROM flights WHERE upper(flight_number) = upper(flight_no) AND flight_date = on_day",
    ),
    "check_transit_eligibility": (
        "arrival_no STRING, arrival_day DATE, departure_no STRING, departure_day DATE",
        "arrival_at TIMESTAMP_NTZ, departure_at TIMESTAMP_NTZ, transit_hours DOUBLE, success BOOLEAN, error STRING, eligible BOOLEAN",
        f"SELECT {_ARRIVES} AS arrival_at, {_LEAVES} AS departure_at, CASE WHEN departure_at >= arrival_at THEN round(timestampdiff(SECOND, arrival_at, departure_at) / 3600.0D, 2) END AS transit_hours, transit_hours IS NOT NULL AS success,"
        " CASE WHEN arrival_at IS NULL THEN 'Arrival flight not found.' WHEN departure_at IS NULL THEN 'Departure flight not found.' WHEN departure_at < arrival_at THEN 'Departure occurs before arrival.' END AS error,"
        f" transit_hours BETWEEN {LEAST_HOURS} AND {MOST_HOURS} AS eligible",
    ),
    "list_fst_sessions": (
        "on_day DATE",
        "session_code STRING, tour_name STRING, start_datetime TIMESTAMP_NTZ, remaining_slots INT, status STRING, session_count BIGINT",
        "SELECT session_code, tour_name, start_datetime, remaining_slots, status, count(*) OVER () FROM fst_sessions WHERE service_date = on_day",
    ),
}


def register(spark: SparkSession, flights: DataFrame, sessions: DataFrame) -> None:
    """Names the views flights and fst_sessions and makes the table functions over them."""
    flights.createOrReplaceTempView("flights")
    sessions.createOrReplaceTempView("fst_sessions")
    found = f"SELECT min_by({_AT}, id) FROM flights WHERE upper(flight_number) = upper(flight_no) AND flight_date = on_day AND upper(direction) = way"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION flight_time(flight_no STRING, on_day DATE, way STRING) RETURNS TIMESTAMP_NTZ RETURN {found}")
    for name, (takes, gives, body) in TOOLS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")
