"""Collecting pages: what to fetch is a query, fetching is a call that the caller supplies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.html import page_links
from ..functions.text import collapse
from ..operators.dedup import last_seen

#: Tries, and seconds to wait after the nth for each n.
TRIES, BACKOFF = 3, 2.0
#: The pages to start from, and what a link must hold to be followed.
_TOURS = "https://www.changiairport.com/en/experience/tours/free-singapore-tour"
TOUR_PAGES = (
    ("free_sg_tour", "Free Singapore Tour", "tour", f"{_TOURS}.html"),
    ("sentosa_discovery_tour", "Sentosa Discovery Tour", "tour", f"{_TOURS}/sentosa-discovery-tour.html"),
    ("city_sights_tour", "City Sights Tour", "tour", f"{_TOURS}/city-sight-tour.html"),
    ("singapore_river_and_marina_bay_sands", "Singapore River and Marina Bay Sands", "tour", f"{_TOURS}/singapore-river-mbs.html"),
    ("heritage_and_culture_tour", "Heritage And Culture Tour", "tour", f"{_TOURS}/heritage-and-culture-tour.html"),
)
VISA_PAGES = (("ica_visa_requirements", "ICA Visa Requirements", "visa_index", "https://www.ica.gov.sg/enter-transit-depart/entering-singapore/visa_requirements"),)
VISA_LINKS = ("/enter-transit-depart/entering-singapore/visa_requirements/visa-detail-page/",)
ROWS = "page_id string, url string, http_status int, fetch_status string, error string, html string"


def configured(spark: SparkSession, pages: tuple[tuple[str, str, str, str], ...]) -> DataFrame:
    """(page_id, name, page_type, url) of pages to start from."""
    return spark.createDataFrame(list(pages), "page_id string, name string, page_type string, url string")


def children(pages: DataFrame, hosts: list[str], contains: list[str]) -> DataFrame:
    """(page_id, url, discovered_from, link_text): allowed links of fetched pages (url, html), the last of each address, by page_id."""
    links = pages.select(F.col("url").alias("discovered_from"), F.posexplode(page_links(F.col("html"), F.col("url"))).alias("at", "l"))
    found = links.filter(urls.allowed(F.col("l.url"), F.col("discovered_from"), hosts, contains))
    rows = found.select(urls.canonical(F.col("l.url")).alias("url"), "discovered_from", collapse(F.col("l.text")).alias("link_text"), "at")
    kept = last_seen(rows, ["url"], "at", "discovered_from")
    return kept.select(urls.page_id(F.col("url")).alias("page_id"), "url", "discovered_from", "link_text").orderBy("page_id", "url")


def fetched(targets: DataFrame, get: Callable[[str], tuple[int, str]], tries: int = TRIES, backoff: float = BACKOFF) -> DataFrame:
    """targets (page_id, url) with what get gave: status, html, or the last error after so many tries. A status from 400 up is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for page, url in zip(f["page_id"], f["url"]):
                row: tuple = ()
                for n in range(1, tries + 1):
                    try:
                        status, html = get(url)
                        row = (page, url, status, "success", None, html) if status < 400 else (page, url, status, "failed", f"HTTP {status}", None)
                    except Exception as failed:  # one page that fails is a row of the log
                        row = (page, url, None, "failed", str(failed) or type(failed).__name__, None)
                    if row[3] == "success" or n == tries:
                        break
                    time.sleep(backoff * n)
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"http_status": "Int32"})

    return targets.select("page_id", "url").mapInPandas(run, ROWS)
