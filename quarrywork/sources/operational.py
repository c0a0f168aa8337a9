"""Operational fixtures and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Number, date, direction, origin, destination, terminal, scheduled time.
FLIGHTS = (
    ("SQ12", "2026-08-20", "ARRIVAL", "NRT", "SIN", "T3", "2026-08-20 07:45:00"),
    ("SQ318", "2026-08-20", "DEPARTURE", "SIN", "LHR", "T3", "2026-08-20 21:00:00"),
    ("TR101", "2026-08-20", "ARRIVAL", "BKK", "SIN", "T1", "2026-08-20 11:30:00"),
    ("TR201", "2026-08-20", "DEPARTURE", "SIN", "KUL", "T1", "2026-08-20 15:30:00"),
    ("AI101", "2026-08-20", "ARRIVAL", "DEL", "SIN", "T2", "2026-08-20 09:00:00"),
    ("AI202", "2026-08-21", "DEPARTURE", "SIN", "BOM", "T2", "2026-08-21 10:00:00"),
    ("CX101", "2026-08-20", "ARRIVAL", "HKG", "SIN", "T4", "2026-08-20 06:00:00"),
    ("CX202", "2026-08-20", "DEPARTURE", "SIN", "HKG", "T4", "2026-08-20 11:30:00"),
)
#: Code, tour, start, end, reporting deadline, required departure, slots left, status; all on one day, of 20.
SESSIONS = (
    ("01", "Heritage and Culture Tour", "10:00", "12:30", "08:30", "14:30", 8, "OPEN"),
    ("02", "City Sights Tour", "12:00", "14:30", "10:30", "16:30", 3, "OPEN"),
    ("03", "Singapore River and Marina Bay Sands Tour", "13:00", "15:30", "11:30", "17:30", 0, "FULL"),
    ("04", "Sentosa Discovery Tour", "15:00", "17:30", "13:30", "19:30", 5, "OPEN"),
    ("05", "Singapore River and Marina Bay Sands Tour", "16:00", "18:30", "14:30", "20:30", 7, "OPEN"),
    ("06", "City Sights Tour", "18:00", "20:30", "16:30", "22:30", 2, "OPEN"),
    ("07", "Sentosa Discovery Tour", "19:00", "21:30", "17:30", "23:30", 6, "OPEN"),
)
SERVICE_DATE = "2026-08-20"


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    wanted = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def flights(spark: SparkSession) -> DataFrame:
    rows = [(i, *f, None, "SCHEDULED") for i, f in enumerate(FLIGHTS, 1)]
    return _typed(spark.createDataFrame(rows, "id bigint, flight_number string, flight_date string, direction string, origin string, destination string, terminal string, scheduled_datetime string, estimated_datetime string, status string"), schemas.FLIGHTS)


def sessions(spark: SparkSession) -> DataFrame:
    rows = [(i, f"FST-{SERVICE_DATE.replace('-', '')}-{code}", SERVICE_DATE, tour, *[f"{SERVICE_DATE} {t}:00" for t in spans], 20, slots, status) for i, (code, tour, *spans, slots, status) in enumerate(SESSIONS, 1)]
    return _typed(spark.createDataFrame(rows, "id bigint, session_code string, service_date string, tour_name string, start_datetime string, end_datetime string, reporting_deadline string, required_departure_after string, capacity int, remaining_slots int, status string"), schemas.SESSIONS)


def create_tables(spark: SparkSession, database: str = "default") -> dict[str, int]:
    """Writes both tables anew; the number of rows of each."""
    for name, rows in (("flights", flights(spark)), ("fst_sessions", sessions(spark))):
        rows.write.mode("overwrite").saveAsTable(f"{database}.{name}")
    return {name: spark.table(f"{database}.{name}").count() for name in ("flights", "fst_sessions")}
