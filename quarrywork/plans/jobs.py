"""Batch jobs: raw pages and files to canonical documents, documents to an index, questions to evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, curate_tour, curate_visa, curate_word, extract, retrieval
from ..sources import fetch, files


def collect(spark: SparkSession, get: Callable[[str], tuple[int, str]], path: str, tours: bool = True, visa: bool = True) -> DataFrame:
    """Fetches the configured pages, and the visa pages their index links to, by get; lands them, writes the manifest, and gives the manifest's pages."""
    seeds = [p for p, wanted in ((fetch.TOUR_PAGES, tours), (fetch.VISA_PAGES, visa)) if wanted]
    start = reduce(DataFrame.unionByName, [fetch.configured(spark, p) for p in seeds])
    files.land_pages(fetch.fetched(start, get), f"{path}/start")
    first = spark.read.schema(f"{fetch.ROWS}, collected_at string").json(f"{path}/start/metadata").drop("html", "collected_at")
    rows = first.withColumns({"discovered_from": F.lit(None).cast("string"), "link_text": F.lit(None).cast("string")})
    if visa:
        index = files.landed_pages(spark, f"{path}/start").join(fetch.configured(spark, fetch.VISA_PAGES).select("page_id"), "page_id", "left_semi")
        links = fetch.children(index, ["www.ica.gov.sg"], list(fetch.VISA_LINKS))
        files.land_pages(fetch.fetched(links, get), f"{path}/linked")
        more = spark.read.schema(f"{fetch.ROWS}, collected_at string").json(f"{path}/linked/metadata").drop("html", "collected_at")
        rows = rows.unionByName(more.join(links.select("page_id", "discovered_from", "link_text"), "page_id"))
    good = F.col("fetch_status") == "success"
    files.write_manifest(rows.withColumn("html_path", F.when(good, F.concat(F.lit("html/page_id="), "page_id"))), f"{path}/manifest", "web", "pages")
    return files.manifest(spark, f"{path}/manifest")


def curate_html(tour: DataFrame | None, visa: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(documents, report) of raw pages (id, url, html) of either kind."""
    docs, reports = [], []
    for pages, read, curate in ((tour, extract.tour_pages, lambda p: curate_tour.curate(p)[0]), (visa, extract.visa_pages, curate_visa.curate)):
        if pages is None:
            continue
        done = read(pages)
        docs.append(curate(done.filter("page IS NOT NULL").select("page.*")))
        reports.append(extract.report(done))
    return reduce(DataFrame.unionByName, docs), reduce(DataFrame.unionByName, reports)


def curate_word_files(spark, folder: str) -> DataFrame:
    return curate_word.curate(files.word_files(spark, folder))


def build_index(documents: DataFrame, path: str, model: chunking.Model | None = None) -> DataFrame:
    """Chunks of documents with embeddings, written; a row of counts. model: as in chunking.embed()."""
    rows = chunking.children(files.unique(documents))
    files.write_index(chunking.embed(rows, model=model), path)
    return chunking.summary(documents.sparkSession.read.parquet(path))


def evidence(index: DataFrame, documents: DataFrame, questions: DataFrame, model: chunking.Model | None = None) -> DataFrame:
    """Cited evidence for (query_id, text) questions: words and vectors, fused, one chunk a parent, rescored, expanded."""
    postings = retrieval.postings(index, "chunk_id", "text", stem=False)
    by_words = retrieval.bm25(postings, *retrieval.statistics(index, "chunk_id", postings), questions)
    asked = chunking.embed(questions.withColumn("prefixed", F.concat(F.lit(retrieval.QUERY_PREFIX), "text")), "prefixed" if model else "text", model=model).select("query_id", F.col("embedding").alias("query_vector"))
    fused = retrieval.fuse(retrieval.nearest(index, "chunk_id", "embedding", asked), by_words)
    top = retrieval.one_per_parent(fused, index.select(F.col("chunk_id").alias("doc"), F.col("parent_doc_id").alias("parent")))
    texts = top.join(index.select(F.col("chunk_id").alias("doc"), "text"), "doc")
    ranked = retrieval.rerank(top, retrieval.lexical_scorer(texts, "text", questions), retrieval.FUSED_K)
    found = retrieval.expand(ranked, documents.withColumnRenamed("doc_id", "parent"))
    return found.withColumn("block", retrieval.evidence_text(F.col("citation"), F.col("title"), F.col("heading_path"), F.col("url"), F.col("page"), F.col("content")))
