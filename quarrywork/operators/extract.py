"""Raw pages to processed records: tour pages and visa pages, with a report of what failed.

A parser makes one JSON record of a page in an Arrow UDF; its columns are then
read with a schema, so that everything behind it is Spark's.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dom import HEADINGS, Node, line, render, tree
from .curate_tour import PAGE as TOUR_PAGE

#: What isn't a tour page's content.
NOISE = ("script", "style", "noscript", "template", "sly", "header", "footer", "nav", ".cmp-breadcrumb", ".cmp-navigation", ".website-survey", ".cmp-cookie")
UNSUPPORTED = "Unsupported page type"


def _distinct(items: list[dict], *keys: str) -> list[dict]:
    seen: dict[tuple, dict] = {}
    for item in items:
        seen.setdefault(tuple(str(item.get(k) or "").lower() for k in keys), item)
    return list(seen.values())


# ---- tour pages


def _image(node: Node, base: str) -> str:
    source = node.get("src") or node.get("data-src") or node.get("data-lazy-src") or node.get("srcset").split(",")[0].strip().split(" ")[0]
    return urljoin(base, source) if source and not source.startswith("data:") else ""


def _around(node: Node, base: str) -> tuple[str, str]:
    """Heading and text of the nearest of five ancestors that has one."""
    at, steps = node.parent, 0
    while at is not None and steps < 5:
        head = at.first(".cmp-banner__title .cmp-title__text", *HEADINGS)
        if head is not None:
            body = at.first(".cmp-banner__description .cmp-text", "p")
            return head.words(), render(body, base)
        at, steps = at.parent, steps + 1
    return "", ""


def _images(main: Node, base: str) -> list[dict]:
    found = []
    for node in main.all("img"):
        if url := _image(node, base):
            heading, text = _around(node, base)
            found.append({"url": url, "alt": line(node.get("alt")), "nearby_heading": heading, "nearby_text": text})
    return _distinct(found, "url")


def _itineraries(main: Node, base: str) -> list[dict]:
    found = []
    for s, slider in enumerate(main.all(".cmp-cardlisting--tlslider__container"), 1):
        for n, slide in enumerate(slider.all(".swiper-slide"), 1):
            card = slide.first(".cmp-banner") or slide
            head, body = card.first(".cmp-banner__title .cmp-title__text", *HEADINGS), card.first(".cmp-banner__description .cmp-text")
            title, text = head.words() if head else "", render(body, base)
            picture = card.first(".cmp-banner__image img", "img")
            asset = card.first(".cmp-image")
            url = (_image(picture, base) if picture else "") or (urljoin(base, asset.get("data-asset")) if asset and asset.get("data-asset") else "")
            if title or text:
                found.append({"title": title, "description": text, "image": {"url": url, "alt": line(picture.get("alt")) if picture else ""}, "source_component": "tlslider", "slider_index": s, "slide_index": n, "_url": url})
    kept = _distinct(found, "title", "description", "_url")
    return [{k: v for k, v in x.items() if k != "_url"} | {"index": i} for i, x in enumerate(kept, 1)]


def _registration(main: Node, base: str) -> dict | None:
    """The component whose heading speaks of registration: bold underlined lines begin subsections, bold starts of items are labels."""
    head = next((h for h in main.all(".cmp-banner__title .cmp-title__text", *HEADINGS) if "registration" in h.words().lower()), None)
    if head is None:
        return None
    box = head.parent
    while box is not None and not box.all(".text .cmp-text", "div.cmp-text"):
        box = box.parent
    sections: list[dict] = []
    for text in box.all(".text .cmp-text", "div.cmp-text") if box else []:
        for part in [e for e in text.elements() if e.tag in ("p", "ul", "ol")]:
            mark = part.first("b u", "u b", "strong u", "u strong")
            if mark is not None and part.tag == "p":
                sections.append({"title": mark.words(), "content": "", "items": []})
                rest = line(part.words().replace(mark.words(), "", 1))
                if rest:
                    sections[-1]["content"] = rest
                continue
            if not sections:
                sections.append({"title": "", "content": "", "items": []})
            if part.tag == "p":
                more = render(part, base)
                sections[-1]["content"] = "\n".join(x for x in (sections[-1]["content"], more) if x)
                continue
            for item in part.all("li"):
                bold, whole = item.first("b", "strong"), render(item, base)
                label = bold.words().rstrip(":").strip() if bold else ""
                content = whole[len(bold.words()) :].lstrip(" :") if bold and whole.startswith(bold.words()) else whole
                sections[-1]["items"].append({"label": label if content != whole else "", "content": content})
    return {"title": head.words(), "subsections": [s for s in sections if s["content"] or s["items"]]} if sections else None


def _tables(main: Node, base: str) -> list[dict]:
    out = []
    for node in main.all("table"):
        rows = [[render(c, base) for c in r.all("td", "th")] for r in node.all("tr")]
        caption, notes, behind = node.first("caption"), [], node
        while behind.parent is not None and behind.parent.tag == "div" and len(behind.parent.elements()) == 1:
            behind = behind.parent
        siblings = behind.parent.elements() if behind.parent else []
        for after in siblings[siblings.index(behind) + 1 :] if behind in siblings else []:
            if after.tag != "p":
                break
            if text := render(after, base):
                notes.append(text)
        out.append({"caption": caption.words() if caption else "", "headers": [c.words() for c in node.all("th")], "rows": [r for r in rows if r], "notes": notes})
    return out


def _accordions(main: Node, base: str) -> list[dict]:
    found = []
    for item in main.all(".cmp-accordion__item"):
        head, body = item.first(".cmp-accordion__header", ".cmp-accordion__button", ".cmp-accordion__title"), item.first(".cmp-accordion__panel", ".cmp-accordion__content")
        title, text = head.words() if head else "", render(body, base)
        if title or text:
            found.append({"title": title, "content": text, "heading_path": []})
    return _distinct(found, "title", "content")


def _tabs(main: Node, base: str) -> list[dict]:
    out = []
    for box in main.all(".cmp-tabs"):
        names = [b.words() for b in box.all(".cmp-tabs__tab")]
        for i, panel in enumerate(box.all(".cmp-tabs__tabpanel")):
            out.append({"title": names[i] if i < len(names) else "", "content": render(panel, base), "sections": [], "accordions": _accordions(panel, base), "tables": _tables(panel, base)})
    return out


def _sections(main: Node, base: str) -> list[dict]:
    """Headings with the texts of the siblings behind them, up to the next heading."""
    out, path = [], []
    for head in main.all("h1", "h2", "h3"):
        level, title = int(head.tag[1]), head.words()
        path = [p for p in path if p[0] < level] + [(level, title)]
        siblings = head.parent.elements() if head.parent else []
        content: list[str] = []
        for after in siblings[siblings.index(head) + 1 :]:
            if after.tag in HEADINGS or after.first(*HEADINGS):
                break
            text = render(after, base)
            if text and text not in content:
                content.append(text)
        if title and content:
            out.append({"heading": title, "heading_path": [p[1] for p in path], "content": content})
    return out


def tour_page(html: str | None, url: str | None, page: str, name: str | None = None) -> dict:
    root, base = tree(html), url or ""
    main = root.first("main") or root.first("#main-content") or root.first(".root.container") or root.first("body") or root
    head = root.first("h1")
    meta = next((m.get("content") for m in root.all("meta") if m.get("name") == "title"), "")
    title = (head.words() if head else "") or line(meta) or (root.first("title").words() if root.first("title") else "")
    main.drop(*NOISE)
    links = [{"text": a.words(), "url": urljoin(base, a.get("href"))} for a in main.all("a") if a.get("href") and not a.get("href").startswith("#")]
    return {
        "id": page, "name": name or title, "page_type": "tour", "url": base, "title": title, "sections": _sections(main, base), "registration_details": _registration(main, base), "itineraries": _itineraries(main, base),
        "tabs": _tabs(main, base), "accordions": _accordions(main, base), "tables": _tables(main, base), "images": _images(main, base), "links": list({(x["text"], x["url"]): x for x in links}.values()),
    }


# ---- visa pages


def page_title(root: Node) -> str:
    head = root.first("h1.my-bread-crumbs-title") or root.first("h1")
    if head is not None and head.words():
        return head.words()
    title = root.first("title")
    return title.words().removeprefix("ICA |").strip() if title else ""


def page_type(root: Node, page: str) -> str:
    if root.first(".visa-detail"):
        return "visa_detail"
    if root.first(".countries-list__links"):
        return "visa_index"
    return "vftf" if "visa free transit facility" in page_title(root).lower() or page == "visa-free-transit-facility" else "unknown"


def _items(node: Node, base: str) -> list[str]:
    texts = (render(li, base).lstrip("-– ").strip() for li in node.elements() if li.tag == "li")
    return [t for t in texts if t]


def _country(title: str) -> str:
    return line(title[: -len("visa requirements")]) if title.lower().endswith("visa requirements") else title


def _group_head(node: Node) -> bool:
    bold = node.first("strong") if node.tag == "p" else None
    return bold is not None and bold.words().lower().startswith("nationals of")


def visa_page(html: str | None, url: str | None, page: str) -> dict:
    root, base = tree(html), url or ""
    kind = page_type(root, page)
    if kind == "unknown":
        raise ValueError(f"{UNSUPPORTED}: {page}")
    record: dict = {"id": page, "source": "ICA", "page_type": kind, "title": page_title(root), "url": base}
    article = root.first(".standard-content .sf_colsIn.article") or root.first("article") or root
    if kind == "visa_index":
        record |= {"overview": render(article, base), "sections": []}
        listed = ""
        for box in root.all(".collapse-wrapper"):
            head, body = box.first(".collapse-title"), box.first(".collapse-content")
            title = head.drop("a.btn", "button").words() if head else ""
            if box.first(".countries-list"):
                listed = title
            elif title:
                record["sections"].append({"title": title, "content": render(body, base)})
        links = [a for a in root.all(".countries-list__links a") if "visa-detail-page" in a.get("href")]
        record["country_list"] = {"title": listed, "description": "", "countries": _distinct([{"name": a.words(), "url": urljoin(base, a.get("href"))} for a in links if a.words()], "url")}
    elif kind == "visa_detail":
        need, sections = [], []
        for block in [e for e in root.first(".visa-detail").elements() if e.tag == "div" and "standard-rich-text" in e.classes]:
            box = block.first(".standard-rich-text__title")
            head = box.first("h1", "h2", "h3") if box else None
            if head is None:
                need.append(render(block, base))
                continue
            if not head.words():
                continue
            notes = [render(t, base) for t in block.all(".tooltip-content")]
            actions = [{"text": a.words(), "url": urljoin(base, a.get("href"))} for a in box.all("a.btn") if a.get("href")]
            title = head.words()
            block.drop(".standard-rich-text__title")
            sections.append({"title": title, "content": render(block, base), "notes": [n for n in notes if n], "actions": actions})
        record |= {"country": _country(record["title"]), "visa_requirement": {"required": True, "content": "\n\n".join(n for n in need if n)}, "sections": sections}
    else:
        intro, groups, notes, open_group = [], [], [], None
        for node in article.elements():
            if node.get("id").startswith("ftn") and node.get("id")[3:].isdigit():
                number = node.get("id")[3:]
                notes.append({"id": node.get("id"), "number": number, "content": render(node, base)})
                open_group = None
            elif _group_head(node):
                open_group = {"title": _without_marks(node.words()), "content": "", "requirements": []}
                groups.append(open_group)
            elif notes and node.tag in ("ul", "ol"):
                notes[-1]["content"] += "\n" + render(node, base)
            elif open_group is not None and node.tag in ("ul", "ol"):
                open_group["requirements"] += _items(node, base)
            elif node.tag == "p" and (text := render(node, base)):
                if open_group is not None:
                    open_group["content"] = "\n\n".join(x for x in (open_group["content"], text) if x)
                elif not notes:
                    intro.append(text)
        record |= {"overview": "\n\n".join(intro), "eligibility_groups": groups, "footnotes": notes}
    return record


def _without_marks(text: str) -> str:
    import re

    return line(re.sub(r"\s*\[\d+\]\s*", " ", text))


# ---- on Spark


def _parsed(reader: Callable[..., dict], html: Column, url: Column, page: Column) -> Column:
    @F.pandas_udf("struct<record: string, error: string>")
    def parse(pages: pd.Series, urls: pd.Series, ids: pd.Series) -> pd.DataFrame:
        out = []
        for p, u, i in zip(pages, urls, ids):
            try:
                out.append((json.dumps(reader(p, u, i), ensure_ascii=False), None))
            except Exception as failed:  # one page that fails is a row of the report, not the end of the job
                out.append((None, str(failed) or type(failed).__name__))
        return pd.DataFrame(out, columns=["record", "error"])

    return parse(html, url, page)


def _extracted(pages: DataFrame, reader: Callable[..., dict], schema: str) -> DataFrame:
    """id, url and html to page (a struct by schema, null where it failed), json and error."""
    rows = pages.select("id", "url", _parsed(reader, F.col("html"), F.col("url"), F.col("id")).alias("x"))
    return rows.select("id", "url", F.from_json("x.record", schema).alias("page"), F.col("x.record").alias("json"), F.col("x.error").alias("error"))


def tour_pages(pages: DataFrame) -> DataFrame:
    return _extracted(pages, tour_page, TOUR_PAGE)


def visa_pages(pages: DataFrame) -> DataFrame:
    return _extracted(pages, visa_page, schemas.VISA_PAGE)


def report(extracted: DataFrame) -> DataFrame:
    """(page_id, status, error) for each page."""
    return extracted.select(F.col("id").alias("page_id"), F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "error").orderBy("page_id")


#: Counted parts of a page: the column of the count, and the list.
PARTS = (
    ("section_count", "sections"), ("registration_subsection_count", "registration_details.subsections"), ("itinerary_count", "itineraries"), ("tab_count", "tabs"), ("accordion_count", "accordions"),
    ("table_count", "tables"), ("image_count", "images"), ("link_count", "links"), ("country_count", "country_list.countries"),
)


def extraction_summary(pages: DataFrame) -> DataFrame:
    """(page_id, a count for each list that pages of this kind have); a list that isn't there counts 0."""
    counts = [F.greatest(F.coalesce(F.size(part), F.lit(0)), F.lit(0)).alias(name) for name, part in PARTS if part.split(".")[0] in pages.columns]
    return pages.select(F.col("id").alias("page_id"), *counts)


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_count"), F.count_if(F.col("status") == "success").alias("successful_count"), F.count_if(F.col("status") == "failed").alias("failed_count"))


def source_records(manifest: DataFrame, local: DataFrame) -> DataFrame:
    """Pages fetched with success by the manifest, then local files it doesn't name, by page_id. Both: (page_id, url, html_path, ...)."""
    good = manifest.filter((F.col("fetch_status") == "success") & (F.coalesce("page_id", F.lit("")) != "")).select("page_id", "url", "html_path")
    more = local.join(good, "page_id", "left_anti").select("page_id", "url", "html_path")
    return good.unionByName(more).orderBy("page_id")
