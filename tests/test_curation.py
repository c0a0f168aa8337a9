import io
import json
import zipfile

import pytest

from quarrywork import schemas
from quarrywork.operators import curate_pdf, curate_tour, curate_visa, curate_word, extract
from quarrywork.sources import files
from quarrywork.streaming.maintain import maintain_index


def rows_of(spark, records, schema):
    text = spark.createDataFrame([(json.dumps(r),) for r in records], "v string")
    from pyspark.sql import functions as F

    return text.select(F.from_json("v", schema).alias("r")).select("r.*")


def paragraph(text, bold=False, item=False, level=0, links=()):
    return {"type": "paragraph", "text": text, "formatting": {"mostly_bold": bold}, "list": {"is_list_item": item, "level": level}, "hyperlinks": [{"text": t, "url": u} for t, u in links]}


def test_word(spark):
    blocks = [paragraph("Rules"), paragraph("intro"), paragraph("Appeals", True), paragraph("Empty", True), paragraph("Sub", True), paragraph("x", item=True, level=1, links=[("f", "http://f")]), {"type": "table", "rows": [["a", "b"], ["1", "2"]]}, paragraph("Prohibited Goods"), paragraph("y")]
    got = curate_word.curate(rows_of(spark, [{"source_file": "r.docx", "blocks": blocks}], schemas.WORD_FILE)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == ["customs-word-01-overview", "customs-word-02-sub", "customs-word-03-prohibited-goods"]
    assert got[1].content == "- x\n\na: 1\nb: 2\n\nReferences:\n- f: http://f"
    assert got[1].heading_path == "Rules > Appeals > Sub" and got[2].heading_path == "Rules > Appeals > Prohibited Goods"


def test_visa(spark):
    pages = [
        {"id": "ix", "page_type": "visa_index", "title": "Visas", "url": "u", "overview": "o", "sections": [{"title": "S", "content": "c"}, {"title": "E", "content": ""}], "country_list": {"countries": [{"name": "India"}, {"name": "Iran"}]}},
        {"id": "in", "page_type": "visa_detail", "country": "India", "title": "India", "visa_requirement": {"required": True, "content": "need"}, "sections": [{"title": "Fees", "content": "f", "notes": ["n"], "actions": [{"text": "Go", "url": "g"}]}]},
        {"id": "vf", "page_type": "vftf", "title": "VFTF", "overview": "", "eligibility_groups": [{"title": "Nationals of the PRC", "content": "see [3]", "requirements": ["r"]}], "footnotes": [{"number": "2", "content": "two"}, {"number": "3", "content": "three"}]},
        {"id": "no", "page_type": "other"},
    ]
    got = {r.doc_id: r for r in curate_visa.curate(rows_of(spark, pages, schemas.VISA_PAGE)).collect()}
    assert set(got) == {"ix_overview", "ix_s_01", "ix_travel_documents_countries_places", "ica_india_visa_requirement", "ica_india_fees", "vf_nationals_of_the_prc"}
    assert got["ica_india_fees"].content == "f\n\nAdditional notes:\nn\n\nActions:\n- [Go](g)"
    assert got["vf_nationals_of_the_prc"].content == "see [3]\n\nRequirements:\n- r\n\nRelevant ICA notes:\nthree\n\ntwo"
    assert json.loads(got["ix_travel_documents_countries_places"].metadata)["country_count"] == 2


def test_tour(spark):
    page = {
        "id": "t", "title": "Tour", "url": "u", "registration_details": {"title": "Registration", "subsections": [{"title": "Counters", "content": "", "items": [{"label": "T1", "content": "level two"}]}]},
        "itineraries": [{"title": "Stop", "description": "A long description of the stop that is surely covered.", "image": {"url": "http://i/1"}}], "tables": [{"headers": ["Reporting Time"], "rows": [["8"]], "notes": ["n"]}],
        "accordions": [{"title": "1. Why?", "content": "Because."}], "images": [{"url": "http://i/1", "alt": "a", "nearby_text": "x"}, {"url": "http://i/2", "nearby_text": "y"}],
        "sections": [{"heading": "More", "heading_path": ["More"], "content": ["A long description of the stop that is surely covered.", "We apologise for this.", "Plain words.", "Because."]}],
        "tabs": [{"title": "Where", "content": "", "location_directory": {"locations": [{"location_name": "Desk", "level": "2"}]}}],
    }
    docs, assets = curate_tour.curate(rows_of(spark, [page], curate_tour.PAGE))
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {"fst_t_registration_001", "fst_t_itinerary_001", "fst_t_table_001", "fst_t_faq_001", "fst_t_notice_001", "fst_t_section_002", "fst_t_tab_001_location_001"}
    assert got["fst_t_table_001"].content == "Reporting Time\n---\n8\n\nNotes:\n- n" and got["fst_t_table_001"].heading_path == "Tour > Tour Schedule"
    assert got["fst_t_faq_001"].heading_path == "Tour > Why?" and json.loads(got["fst_t_notice_001"].metadata)["time_sensitive"] is True
    assert json.loads(got["fst_t_itinerary_001"].metadata)["asset_ids"] == ["fst_t_image_001"]
    rows = {r.url: r for r in assets.collect()}
    assert rows["http://i/1"].roles == ["page_image", "itinerary_image"] and rows["http://i/1"].nearby_text.startswith("A long")


def _pdf(missing=False):
    spots = {"01": (0.1, 0.1), "03": (0.1, 0.3), "05": (0.1, 0.5), "07": (0.1, 0.7), "02": (0.6, 0.1), "04": (0.6, 0.3), "06": (0.6, 0.5)}
    lines = [{"text": f"{n}.", "bbox_normalized": [x, y, x + 0.02, y + 0.01], "links": []} for n, (x, y) in spots.items() if not (missing and n == "04")]
    add = lambda text, x, y, links=(): lines.append({"text": text, "bbox_normalized": [x, y, x + 0.1, y + 0.01], "links": list(links)})
    add("Plants and", 0.6, 0.15), add("animals", 0.6, 0.17, ["http://p"]), add("Q1:", 0.1, 0.75), add("Why so?", 0.1, 0.77), add("Because.", 0.1, 0.79), add("Delay s", 0.6, 0.55), add("• dot", 0.1, 0.15)
    return {"source_file": "p.pdf", "pages": [{"page_number": 1, "lines": lines}]}


def test_pdf(spark):
    got = {r.doc_id[12:14]: r for r in curate_pdf.curate(rows_of(spark, [_pdf()], schemas.PDF_FILE), "Guide").collect()}
    assert got["02"].content == "- Plants and animals" and json.loads(got["02"].metadata)["links"] == [{"text": "Plants and animals", "url": "http://p"}]
    assert got["07"].content == "Q1: Why so?\nA1: Because." and got["06"].content == "- Delays" and got["01"].content == "- dot"
    with pytest.raises(Exception, match="Missing section anchors: 04"):
        curate_pdf.curate(rows_of(spark, [_pdf(True)], schemas.PDF_FILE), "Guide").collect()


VISA = "<html><h1>India Visa Requirements</h1><div class='visa-detail'><div class='standard-rich-text'><p>Need one.</div><div class='standard-rich-text'><div class='standard-rich-text__title'><h3>Fees</h3><a class='btn' href='/pay'>Pay</a></div><p>S$30</p><div class='tooltip-content'>note</div></div></div></html>"
TOUR = "<html><body><main><h1>City</h1><div class='cmp-cardlisting--tlslider__container'><div class='swiper-slide'><div class='cmp-banner'><div class='cmp-banner__title'><span class='cmp-title__text'>Hall</span></div><div class='cmp-banner__description'><div class='cmp-text'><p>Old.</p></div></div><img src='/i.png'></div></div></div><table><tr><th>A</th></tr><tr><td>1</td></tr></table><p>note</p><h2>More</h2><p>words</p></main></body></html>"


def test_extraction_report(spark):
    pages = spark.createDataFrame([("in", "https://a.org/x", VISA), ("bad", "https://a.org/y", "<p>nothing</p>"), ("none", None, None)], "id string, url string, html string")
    done = extract.visa_pages(pages).cache()
    page = done.filter("id = 'in'").head().page
    assert page.country == "India" and page.visa_requirement.content == "Need one." and page.sections[0].actions[0].url == "https://a.org/pay"
    assert [r.status for r in extract.report(done).collect()] == ["failed", "success", "failed"] and extract.totals(extract.report(done)).head().failed_count == 2
    tour = extract.tour_pages(spark.createDataFrame([("c", "https://a.org/c", TOUR)], "id string, url string, html string")).head().page
    assert tour.itineraries[0].title == "Hall" and tour.itineraries[0].image.url == "https://a.org/i.png" and tour.tables[0].notes == ["note"] and tour.sections[-1].content == ["words"]


def _docx(path):
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    body = "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val='1'/><w:numId w:val='3'/></w:numPr></w:pPr><w:r><w:t>item http://a.b/c.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    path.write_bytes(data.getvalue())


def test_word_files(spark, tmp_path):
    _docx(tmp_path / "a.docx"), _docx(tmp_path / "~$a.docx")
    rows = files.word_files(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    head, item, table = rows[0].blocks
    assert head.formatting.mostly_bold and item.list.level == 1 and item.hyperlinks[0].url == "http://a.b/c" and table.rows == [["x"]]


def test_scans_and_sinks(spark, tmp_path):
    good = {"doc_id": "a", "source": "s", "source_type": "web", "title": "t", "content": " c "}
    (tmp_path / "x_documents.jsonl").write_text(json.dumps(good) + "\n\n")
    docs = files.canonical(spark, str(tmp_path))
    assert docs.head().content == "c" and files.unique(docs).count() == 1
    with pytest.raises(Exception, match="Duplicate document id: a"):
        files.unique(docs.union(docs)).collect()
    (tmp_path / "y_documents.jsonl").write_text(json.dumps(good | {"content": " "}) + "\n")
    with pytest.raises(Exception, match="y_documents.jsonl"):
        files.canonical(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        files.processed(spark, str(tmp_path), schemas.VISA_PAGE)
    assert files.manifest(spark, f"{tmp_path}/none.json").count() == 0
    pages = spark.createDataFrame([("p", "u", "h", 200, "success", None, None, None), ("q", "u", None, 404, "failed", "e", None, None)], files.MANIFEST_PAGE)
    files.write_manifest(pages, f"{tmp_path}/m", "ICA", "visa")
    assert files.manifest(spark, f"{tmp_path}/m").count() == 2
    local = spark.createDataFrame([("p", "u", "l"), ("z", "u", "l")], "page_id string, url string, html_path string")
    assert [r.page_id for r in extract.source_records(pages, local).collect()] == ["p", "z"]


def test_words_to_lines(spark):
    words = spark.createDataFrame([("f", 1, 100.0, 200.0, 10.0, 20.0, 20.0, 30.0, "b", 0, 0, 1), ("f", 1, 100.0, 200.0, 1.0, 20.0, 9.0, 30.0, "a", 0, 0, 0)], "source_file string, page_number int, width double, height double, x0 double, y0 double, x1 double, y1 double, word string, block_no int, line_no int, word_no int")
    row = files.lines_of_words(words).head()
    assert row.text == "a b" and row.bbox == [1.0, 20.0, 20.0, 30.0] and row.bbox_normalized == [0.01, 0.1, 0.2, 0.15]


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"doc_id": "a", "source": "s", "source_type": "web", "title": "t", "content": "c"}))
    for _ in range(2):
        maintain_index(spark, f"{tmp_path}/in", f"{tmp_path}/index", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/index").count() == 1
