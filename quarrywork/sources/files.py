"""Scans and sinks of files: canonical JSONL, processed JSON, HTML, Word and PDF files, manifests and reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip


def numbered_lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(value, file, line): the lines of text files with their numbers from 1.

    A file's splits are counted and summed up, so a large file is read in parallel; nothing but one row a split is put in order.
    """
    raw = spark.read.option("pathGlobFilter", pattern).text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return raw.join(placed, ["file", "block"]).select("value", "file", (F.col("offset") + F.col("id") - F.col("first") + 1).alias("line"))


def canonical(spark: SparkSession, folder: str, pattern: str = "*_documents.jsonl") -> DataFrame:
    """Canonical documents in order of file name and line; a line that isn't one, or has no content or no id, is an error that names its file and line."""
    raw = numbered_lines(spark, folder, pattern)
    parsed = raw.filter(strip(F.col("value")) != "").withColumn("d", F.from_json("value", schemas.CANONICAL, {"mode": "PERMISSIVE"}))
    sound = F.col("d.doc_id").isNotNull() & (strip(F.coalesce("d.content", F.lit(""))) != "")
    message = F.concat(F.lit("Not a canonical document, in "), "file", F.lit(", line "), F.col("line").cast("string"), F.lit(": "), F.substring("value", 1, 80))
    checked = parsed.withColumn("ok", F.when(sound, F.lit(True)).otherwise(F.raise_error(message)))
    return checked.filter("ok").orderBy("file", "line").select("d.*").withColumn("content", strip(F.col("content")))


def unique(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents, or an error that names an id found twice."""
    twice = documents.groupBy(key).count().filter("count > 1").agg(F.min(key).alias("twice"))  # one row
    bad = twice.withColumn("bad", F.when(F.col("twice").isNotNull(), F.raise_error(F.concat(F.lit("Duplicate document id: "), F.col("twice").cast("string")))).otherwise(F.lit(False)))
    return documents.join(F.broadcast(bad.select("bad")), ~F.col("bad")).drop("bad")


def processed(spark: SparkSession, folder: str, schema: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Processed pages, one JSON file each; files named as reports are left out, and pages of other kinds if kinds are given. None at all is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    rows = rows.filter(~F.contains(F.lower("_metadata.file_name"), F.lit("report")))
    if kinds:
        rows = rows.filter(F.col("page_type").isin(*kinds))
    if rows.isEmpty():
        raise FileNotFoundError(f"no processed files in {folder}")
    return rows


def html_files(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(page_id, path, html)"""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return raw.select(F.regexp_extract("_metadata.file_name", r"^(.*?)\.[^.]*$", 1).alias("page_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


MANIFEST_PAGE = "page_id STRING, url STRING, html_path STRING, http_status INT, fetch_status STRING, error STRING, discovered_from STRING, link_text STRING"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a fetch manifest: of one file with all pages, or of a folder as write_manifest() leaves it; none where there is neither."""
    try:
        return spark.read.schema(MANIFEST_PAGE).json(f"{path}/pages")
    except AnalysisException:
        pass
    try:
        return spark.read.schema(f"pages ARRAY<STRUCT<{MANIFEST_PAGE.replace(' ', ': ').replace(',: ', ', ')}>>").option("multiLine", True).json(path).select(F.explode("pages").alias("p")).select("p.*")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST_PAGE)


# ---- Word files, without a library: a document is XML in a zip

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_URL = re.compile(r"https?://[^\s<>()\"']+")


def _joined(node: ElementTree.Element) -> str:
    out = []
    for n in node.iter():
        out.append(n.text or "" if n.tag == f"{_W}t" else " " if n.tag == f"{_W}tab" else "\n" if n.tag in (f"{_W}br", f"{_W}cr") else "")
    return "".join(out)


def _clean(text: str) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def _links(node: ElementTree.Element, targets: dict[str, str]) -> list[dict]:
    found = []
    for link in node.iter(f"{_W}hyperlink"):
        url = targets.get(link.get(f"{_R}id") or "", "") or ("#" + link.get(f"{_W}anchor") if link.get(f"{_W}anchor") else "")
        if url:
            found.append((_clean(_joined(link)), url))
    known = {u for _, u in found}
    found += [(u, u) for u in (m.rstrip(".,;") for m in _URL.findall(_joined(node))) if u not in known]
    return [{"text": t, "url": u} for t, u in dict.fromkeys(found)]


def _paragraph(node: ElementTree.Element, targets: dict[str, str], styles: dict[str, str]) -> dict | None:
    text = _clean(_joined(node))
    if not text:
        return None
    bold = total = 0
    sizes = []
    for run in node.iter(f"{_W}r"):
        n, look = len(_joined(run).strip()), run.find(f"{_W}rPr")
        mark = look.find(f"{_W}b") if look is not None else None
        total += n
        bold += n if mark is not None and mark.get(f"{_W}val") not in ("0", "false") else 0
        size = look.find(f"{_W}sz") if look is not None else None
        if size is not None:
            sizes.append(int(size.get(f"{_W}val")) / 2)
    props = node.find(f"{_W}pPr")
    style = props.find(f"{_W}pStyle") if props is not None else None
    name = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else "Normal"
    numbered = props.find(f"{_W}numPr") if props is not None else None
    value = lambda tag: int(numbered.find(tag).get(f"{_W}val")) if numbered is not None and numbered.find(tag) is not None else None
    by_style = numbered is None and "list" in (name or "").lower()
    ratio = bold / total if total else 0.0
    return {
        "type": "paragraph", "style": name, "text": text, "formatting": {"bold_ratio": round(ratio, 2), "mostly_bold": ratio >= 0.8, "max_font_size_pt": max(sizes, default=None)},
        "list": {"is_list_item": numbered is not None or by_style, "level": (value(f"{_W}ilvl") or 0) if numbered is not None else 0 if by_style else None, "num_id": value(f"{_W}numId"), "detected_from": "paragraph" if numbered is not None else "style_name" if by_style else None},
        "rows": None, "hyperlinks": _links(node, targets),
    }


def word_blocks(content: bytes) -> list[dict]:
    """Paragraphs and tables of a Word file in the order of its body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = set(z.namelist())
        links = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else []
        looks = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in links}
    styles = {s.get(f"{_W}styleId"): s.find(f"{_W}name").get(f"{_W}val") for s in looks if s.tag == f"{_W}style" and s.find(f"{_W}name") is not None}
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            if (found := _paragraph(node, targets, styles)) is not None:
                out.append(found)
        elif node.tag == f"{_W}tbl":
            rows = [[_clean("\n".join(_joined(p) for p in cell.iter(f"{_W}p"))) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            out.append({"type": "table", "style": None, "text": None, "formatting": None, "list": None, "rows": rows, "hyperlinks": _links(node, targets)})
    return out


def word_files(spark: SparkSession, folder: str) -> DataFrame:
    """Word files with their blocks; lock files are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    named = raw.select(F.col("_metadata.file_name").alias("source_file"), "content").filter(~F.col("source_file").startswith("~$"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"source_file": f["source_file"], "source_type": "word", "blocks": [word_blocks(bytes(c)) for c in f["content"]]})

    return named.mapInPandas(read, schemas.WORD_FILE)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files with the words of their pages gathered to lines; needs the PyMuPDF library, else read processed() JSON."""
    try:
        import fitz  # noqa: F401
    except ImportError as missing:
        raise NotImplementedError("reading PDF needs PyMuPDF; without it, read the processed JSON") from missing
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    named = raw.select(F.col("_metadata.file_name").alias("source_file"), "content").filter(~F.col("source_file").startswith("~$"))

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for f in frames:
            for name, content in zip(f["source_file"], f["content"]):
                with fitz.open(stream=bytes(content), filetype="pdf") as pdf:
                    for n, page in enumerate(pdf, 1):
                        rows = [(name, n, page.rect.width, page.rect.height, *w[:4], w[4], w[5], w[6], w[7]) for w in page.get_text("words")]
                        yield pd.DataFrame(rows, columns=["source_file", "page_number", "width", "height", "x0", "y0", "x1", "y1", "word", "block_no", "line_no", "word_no"])

    return named.mapInPandas(words, "source_file string, page_number int, width double, height double, x0 double, y0 double, x1 double, y1 double, word string, block_no int, line_no int, word_no int")


def lines_of_words(words: DataFrame) -> DataFrame:
    """Words of pages to lines: text in order, the box around them rounded and as shares of the page, in reading order."""
    from ..operators.sections import joined_in_order

    key = ["source_file", "page_number", "width", "height", "block_no", "line_no"]
    line = words.groupBy(*key).agg(joined_in_order(F.col("word"), F.col("word_no"), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).filter("text <> ''")
    sides = (("x0", "width"), ("y0", "height"), ("x1", "width"), ("y1", "height"))
    share = lambda c, size: F.when(F.col(size) > 0, F.round(F.col(c) / F.col(size), 4)).otherwise(0.0)
    return line.select(*key, "text", F.array(*[F.round(c, 2) for c, _ in sides]).alias("bbox"), F.array(*[share(c, s) for c, s in sides]).alias("bbox_normalized")).orderBy("source_file", "page_number", "bbox_normalized")


# ---- sinks


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, as text in UTF-8; many part files, as Spark writes."""
    rows.write.mode("overwrite").json(path)


def write_pages(extracted: DataFrame, path: str) -> None:
    """One folder a page with its record as JSON."""
    extracted.filter("json IS NOT NULL").select(F.col("id").alias("page_id"), F.col("json").alias("value")).write.mode("overwrite").partitionBy("page_id").text(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """The index of chunks, all anew; chunk ids must be there and different."""
    unique(chunks.filter(F.col("chunk_id").isNotNull()), "chunk_id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with text; an index without any is an error."""
    rows = spark.read.parquet(path).filter("text <> ''")
    if rows.isEmpty():
        raise ValueError(f"the index at {path} is empty")
    return rows


def write_manifest(pages: DataFrame, path: str, source: str, dataset: str) -> None:
    """A fetch manifest: the pages in order, one JSON object a line, in path/pages, and one record with counts in path/summary."""
    columns = [c.split()[0] for c in MANIFEST_PAGE.split(", ")]
    pages.select(*columns).orderBy(*columns).write.mode("overwrite").json(f"{path}/pages")
    good = F.coalesce(F.col("fetch_status") == "success", F.lit(False))
    counts = pages.agg(
        F.lit(source).alias("source"), F.lit(dataset).alias("dataset"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("completed_at"), F.count("*").alias("total_count"),
        F.count_if(good).alias("successful_count"), F.count_if(~good).alias("failed_count"),
    )
    counts.write.mode("overwrite").json(f"{path}/summary")  # one row


def land_pages(fetched: DataFrame, path: str) -> None:
    """Raw pages (page_id, url, html, ...) that were fetched: path/html has a folder a page with its html as it is, path/metadata the other columns and when they were collected.

    The html is there whole or not at all: a file gets its name when its task has ended, and _SUCCESS is there when all have.
    """
    good = fetched.filter(F.col("html").isNotNull())
    good.select("page_id", F.col("html").alias("value")).write.mode("overwrite").option("lineSep", "\0").partitionBy("page_id").text(f"{path}/html")
    others = [c for c in fetched.columns if c != "html"]
    fetched.select(*others, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("collected_at")).write.mode("overwrite").json(f"{path}/metadata")


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of pages that land_pages() has written."""
    html = spark.read.text(f"{path}/html", wholetext=True).select(F.col("page_id").cast("string").alias("page_id"), F.regexp_replace("value", "\0$", "").alias("html"))
    return html.join(spark.read.json(f"{path}/metadata").select(F.col("page_id").cast("string").alias("page_id"), "url"), "page_id").select("page_id", "url", "html")
