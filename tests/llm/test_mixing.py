"""The rows of the mix come from one read of the documents."""

import collections

from quarrywork.llm import common, mixing

DATA = "/root/testdata/sf0.001"


def test_texts_are_read_once(spark):
    rows = mixing.sample(spark.read.parquet(f"{DATA}/documents.parquet"), scope="mixing")
    scans = [x for x in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "Scan" in x and "doc_id#" in x]
    assert len(scans) == 1, scans
    common.release(spark, "mixing")


def test_sample_has_the_rows_of_the_mix(spark):
    """Each document whole as often as the mix takes it, and the first words of the one at a source's cut."""
    texts = [" ".join(f"{i}-{j}" for j in range(i % 7)) + " " * (i % 3) for i in range(60)]
    docs = common.saved(spark.createDataFrame([(i, x, "abc"[i % 3], len(x)) for i, x in enumerate(texts)], "doc_id long, text string, source string, n_chars int"), "mixing")
    expected = collections.Counter()
    for r in mixing.mix(docs, scope="mixing").collect():
        if r.taken:
            expected[r.doc_id, texts[r.doc_id], len(texts[r.doc_id])] += r.taken // r.size
        if r.taken and r.taken % r.size:
            part = " ".join(texts[r.doc_id].split()[: r.taken % r.size])
            expected[r.doc_id, part, len(part)] += 1
    got = mixing.sample(docs, scope="mixing")
    assert got.schema == docs.schema
    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == +expected
    common.release(spark, "mixing")
