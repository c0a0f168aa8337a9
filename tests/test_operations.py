import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrywork.functions import times
from quarrywork.operators import operations as ops
from quarrywork.operators import requests
from quarrywork.sources import operational


@pytest.fixture(scope="module")
def judged(spark):
    trips = [("A", "sq12", "2026-08-20", "SQ318", "2026-08-20"), ("B", "TR101", "2026-08-20", "TR201", "2026-08-20"), ("C", "AI101", "2026-08-20", "AI202", "2026-08-21"), ("D", "CX101", "2026-08-20", "CX202", "2026-08-20"), ("E", "XX1", "2026-08-20", "CX202", "2026-08-20")]
    asked = spark.createDataFrame(trips, "request_id string, arrival_flight string, arrival_date string, departure_flight string, departure_date string")
    asked = asked.withColumns({c: F.col(c).cast("date") for c in ("arrival_date", "departure_date")})
    rows = ops.evaluate(operational.flights(spark), operational.sessions(spark), asked).collect()
    return {(r.request_id, r.session_code[-2:]): r for r in rows}


@pytest.mark.parametrize("case,hours,eligible", [("A", 13.25, "01 02 04 05"), ("B", 4.0, ""), ("C", 25.0, "02 04 05 06 07"), ("D", 5.5, "")])
def test_eligibility(judged, case, hours, eligible):
    mine = {k[1]: r for k, r in judged.items() if k[0] == case}
    assert len(mine) == 7 and {r.transit_hours for r in mine.values()} == {hours}
    assert [k for k, r in sorted(mine.items()) if r.eligible] == eligible.split()
    assert all(r.eligible == (not r.reasons) for r in mine.values())


def test_reasons_keep_their_order_and_bounds_are_in_time(judged):
    assert judged["A", "03"].reasons == list(ops.REASONS[:2])
    assert judged["B", "03"].reasons == [ops.REASONS[0], ops.REASONS[1], ops.REASONS[3]]  # the deadline equals the arrival
    assert not [k for k in judged if k[0] == "E"]  # a flight is missing


def test_missing_flight_is_named(spark):
    asked = spark.createDataFrame([("E", "XX1", dt.date(2026, 8, 20), "CX202", dt.date(2026, 8, 20))], "request_id string, arrival_flight string, arrival_date date, departure_flight string, departure_date date")
    assert ops.journeys(operational.flights(spark), asked).head().error == "Arrival flight not found."


def test_lookups(spark):
    flights, sessions = operational.flights(spark), operational.sessions(spark)
    day = F.lit("2026-08-20").cast("date")
    assert ops.find_flight(flights, F.lit("sq12"), day, F.lit("arrival")).head().id == 1
    assert ops.find_flight(flights, F.lit("SQ12"), day, F.lit("DEPARTURE")).isEmpty()
    assert ops.sessions_on(sessions, day).count() == 7 and ops.session_count(sessions, day).head()[0] == 7
    assert ops.find_session(sessions, "FST-20260820-03").head().status == "FULL"


def test_times(spark):
    rows = spark.createDataFrame([("", "2026-01-01T10:00:00"), ("2026-01-01 11:00:00", "x"), (None, None)], "e string, s string")
    assert [str(r[0]) for r in rows.select(times.effective(F.col("e"), F.col("s"))).collect()] == ["2026-01-01 10:00:00", "2026-01-01 11:00:00", "None"]
    with pytest.raises(Exception, match="no estimated or scheduled"):
        rows.filter("s IS NULL").select(times.effective(F.col("e"), F.col("s"), strict=True)).collect()


def test_plan_rules(spark):
    asked = spark.createDataFrame([(1, "India passport: can I take a tour between SQ12 on 2026-08-20 and SQ 318?"), (2, "Can I bring a drone?")], "request_id bigint, text string")
    plans = {r.request_id: r for r in requests.plan_by_rules(asked).collect()}
    assert plans[1].arrival_flight == "SQ12" and plans[1].departure_flight == "SQ318" and plans[1].needs_transit_calculation and plans[1].missing_fields == []
    assert plans[2].missing_fields == [] and not plans[2].needs_arrival_flight_lookup


def test_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS fixtures LOCATION 'file://{tmp_path}/db'")
    assert operational.create_tables(spark, "fixtures") == {"flights": 8, "fst_sessions": 7}
    spark.sql("DROP DATABASE fixtures CASCADE")
