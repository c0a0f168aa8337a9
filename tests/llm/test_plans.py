"""Joins that a hot key may hit: both sides must come from a shuffle, with no aggregate between it and the join, so that AQE can split the key."""

import re

import pytest

from quarrywork.llm import common, components, debruijn, jaccard, simhash

DATA = "/root/testdata/sf0.001"


def joins(plan: str) -> list[list[str]]:
    """Of each sort-merge join, the operators from it down to the shuffles under it."""
    lines = [re.match(r"^([\s:+|-]*)(?:\*\(\d+\) )?(\w+)", x) for x in plan.split("\n")]
    rows = [(len(m[1]), m[2]) for m in lines if m and m[2]]
    found = []
    for i, (depth, name) in enumerate(rows):
        if name != "SortMergeJoin":
            continue
        between, closed = [], None
        for d, n in rows[i + 1 :]:
            if d <= depth:
                break
            if closed is not None and d > closed:
                continue
            closed = d if n in ("Exchange", "ShuffleQueryStage", "AQEShuffleRead") else None
            between.append(n)
        found.append(between)
    return found


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of all tables that the operators write."""
    seen = []
    real = common.saved

    def record(df, scope="session"):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, scope)

    for module in (components, debruijn, jaccard, simhash):
        monkeypatch.setattr(module, "saved", record)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def check(plans, least):
    found = [j for p in plans for j in joins(p)]
    assert len(found) >= least
    for between in found:
        assert between.count("Exchange") == 2 and set(between) <= {"Sort", "Exchange", "Project", "Filter"}, between


def test_reader_of_plans():
    plan = "SortMergeJoin [a#1], [a#2], Inner\n:- Sort [a#1]\n:  +- Exchange hash\n:     +- Scan\n+- Sort [a#2]\n   +- HashAggregate(keys=[a#2])\n      +- Exchange hash\n         +- HashAggregate\n"
    assert joins(plan) == [["Sort", "Exchange", "Sort", "HashAggregate", "Exchange"]]


def test_components(spark, plans):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(0, i) for i in range(20, 40)], "a long, b long")
    assert components.components(edges).select("root").distinct().count() == 1
    check(plans, 4)


def test_substrings(spark, plans):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    debruijn.deduplicate(docs, with_text=False).count()
    # the owners of paths, their sources, and windows of branches; reading at coordinates is a join on documents
    check([p for p in plans if "SortMergeJoin [owner" in p and "lows" not in p], 1)


def test_near_copies(spark, plans):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    jaccard.groups(docs).count()
    simhash.near_duplicates(docs).count()
    check([p for p in plans if "SortMergeJoin [key" in p or "SortMergeJoin [a#" in p], 4)
