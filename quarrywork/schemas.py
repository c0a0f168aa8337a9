"""Schemas of the canonical tables."""

CANONICAL = "doc_id STRING, source STRING, source_type STRING, title STRING, heading_path STRING, content STRING, url STRING, page INT, metadata STRING"
FLIGHTS = "id BIGINT, flight_number STRING, flight_date DATE, direction STRING, origin STRING, destination STRING, terminal STRING, scheduled_datetime TIMESTAMP_NTZ, estimated_datetime TIMESTAMP_NTZ, status STRING"
SESSIONS = "id BIGINT, session_code STRING, service_date DATE, tour_name STRING, start_datetime TIMESTAMP_NTZ, end_datetime TIMESTAMP_NTZ, reporting_deadline TIMESTAMP_NTZ, required_departure_after TIMESTAMP_NTZ, capacity INT, remaining_slots INT, status STRING"
LINKS = "ARRAY<STRUCT<text: STRING, url: STRING>>"
WORD_FILE = f"source_file STRING, source_type STRING, blocks ARRAY<STRUCT<type: STRING, style: STRING, text: STRING, formatting: STRUCT<bold_ratio: DOUBLE, mostly_bold: BOOLEAN, max_font_size_pt: DOUBLE>, list: STRUCT<is_list_item: BOOLEAN, level: INT, num_id: INT, detected_from: STRING>, rows: ARRAY<ARRAY<STRING>>, hyperlinks: {LINKS}>>"
PDF_FILE = "source_file STRING, source_type STRING, page_count INT, pages ARRAY<STRUCT<page_number: INT, width: DOUBLE, height: DOUBLE, lines: ARRAY<STRUCT<text: STRING, block_no: INT, line_no: INT, bbox: ARRAY<DOUBLE>, bbox_normalized: ARRAY<DOUBLE>, links: ARRAY<STRING>>>>>"
VISA_PAGE = f"id STRING, source STRING, page_type STRING, country STRING, title STRING, url STRING, overview STRING, sections ARRAY<STRUCT<title: STRING, content: STRING, notes: ARRAY<STRING>, actions: {LINKS}>>, country_list STRUCT<title: STRING, description: STRING, countries: ARRAY<STRUCT<name: STRING, url: STRING>>>, visa_requirement STRUCT<required: BOOLEAN, content: STRING>, eligibility_groups ARRAY<STRUCT<title: STRING, content: STRING, requirements: ARRAY<STRING>>>, footnotes ARRAY<STRUCT<id: STRING, number: STRING, content: STRING>>"
