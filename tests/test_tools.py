import pytest

from quarrywork.plans import tools
from quarrywork.sources import operational


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    tools.register(spark, operational.flights(spark), operational.sessions(spark))


def test_lookup(spark):
    r = spark.sql("SELECT * FROM lookup_flight('sq12', DATE'2026-08-20')").head()
    assert r.success and r.direction == "ARRIVAL" and r.error is None
    r = spark.sql("SELECT * FROM lookup_flight('XX1', DATE'2026-08-20')").head()
    assert not r.success and r.error == "Flight not found."


@pytest.mark.parametrize("a,ad,d,dd,hours,ok", [("SQ12", "20", "SQ318", "20", 13.25, True), ("TR101", "20", "TR201", "20", 4.0, False), ("AI101", "20", "AI202", "21", 25.0, False), ("CX101", "20", "CX202", "20", 5.5, True)])
def test_transit(spark, a, ad, d, dd, hours, ok):
    r = spark.sql(f"SELECT * FROM check_transit_eligibility('{a}', DATE'2026-08-{ad}', '{d}', DATE'2026-08-{dd}')").head()
    assert r.success and r.transit_hours == hours and r.eligible == ok
    r = spark.sql(f"SELECT * FROM check_transit_eligibility('{a}', DATE'2026-08-{ad}', 'none', DATE'2026-08-{dd}')").head()
    assert not r.success and r.error == "Departure flight not found."


def test_sessions(spark):
    rows = spark.sql("SELECT * FROM list_fst_sessions(DATE'2026-08-20')").collect()
    assert len(rows) == 7 and rows[0].session_count == 7
