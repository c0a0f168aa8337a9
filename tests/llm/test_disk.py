"""What is written on the way goes as soon as nothing reads it."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrywork.llm import common, debruijn

PASSAGE = " ".join(f"w{i}" for i in range(120))
TEXTS = [f"a {PASSAGE} b", f"c d {PASSAGE}", " ".join(f"v{i}" for i in range(200)), f"{PASSAGE} x {PASSAGE}", None]


def shuffle_files(spark) -> int:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f) > 0 for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data"))


def test_shuffles_of_saved_tables_go(spark):
    usual, before = spark.conf.get(common.CLEANUP, None), shuffle_files(spark)
    table = common.saved(spark.range(10_000).groupBy((F.col("id") % 999).alias("k")).count(), "disk")
    for _ in range(50):  # Spark deletes them in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and table.count() == 999 and spark.conf.get(common.CLEANUP, None) == usual
    common.release(spark, "disk")


@pytest.mark.parametrize("bits", [27, 7])
def test_steps_of_substrings_go(spark, monkeypatch, bits):
    """Each table is gone by the time the result is there, and the first by the time paths meet."""
    live, real, old = [], common.saved, {p for of in common._SAVED.values() for p in of}

    def record(df, scope="session"):
        out = real(df, scope)
        live.append({p for of in common._SAVED.values() for p in of} - old)
        return out

    monkeypatch.setattr(debruijn, "saved", record)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in debruijn.deduplicate(rows, with_text=False, scope="disk", bloom_bits=bits).collect()}
    assert got == {0: 0, 1: 120, 2: 0, 3: 240, 4: 0}
    assert {p for of in common._SAVED.values() for p in of} - old == set(common._SAVED["disk"]) and len(common._SAVED["disk"]) == 1
    assert not live[0] & live[3] and len(live) > 8 and max(map(len, live)) <= 8
    assert all(not os.path.exists(p.removeprefix("file://")) for p in set.union(*live) - set(common._SAVED["disk"]))
    common.release(spark, "disk")


def test_substring_stage_keeps_one_table(spark):
    """What the pipeline's stage returns reads one table; those of its steps are gone before the result is written."""
    common.release(spark, corpus_pipeline.SCOPE)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    others = {p for of in common._SAVED.values() for p in of}
    stage = corpus_pipeline.substring_dedup(spark, rows, "")
    assert {p for of in common._SAVED.values() for p in of} - others == set(common._SAVED[corpus_pipeline.SCOPE]) and len(common._SAVED[corpus_pipeline.SCOPE]) == 1
    assert {r.doc_id: r.text for r in stage.collect()} == {0: TEXTS[0], 1: "c d", 2: TEXTS[2], 3: "x", 4: None}
    common.release(spark, corpus_pipeline.SCOPE)
