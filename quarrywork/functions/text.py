"""Column expressions for text: cleaning, slugs, headings, links and rendering. All stay in the JVM.

White space is Unicode's where (?U) says so, because the text that comes in was
typed by people; trimming is done with patterns since trim() knows spaces only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WIDTH = "[\u200b\u200c\u200d\ufeff]"
FOOTNOTE = r"\s*\[\d+\]\s*"
#: Patterns of links in text: markdown, HTML anchors and bare addresses.
MARKDOWN_LINK = r"\[([^\]]+)\]\((https?://[^)\s]+)\)"
HTML_LINK = r"<a\s[^>]*?href=\"([^\"]+)\"[^>]*>(.*?)</a>"
RAW_URL = r"https?://[^\s<>()\"']+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """All white space, no-break spaces included, to one space; ends trimmed; null to empty."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def paragraphs(text: Column) -> Column:
    """Keeps line breaks: one space between words, at most one empty line, no spaces around breaks, no leaked markup."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\u00a0", " ")
    for pattern, put in ((ZERO_WIDTH, ""), (r"(?is)<sly\b[^>]*>.*?</sly>", ""), (r"(?is)<template\b[^>]*>.*?</template>", ""), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, put)
    return strip(out)


def tidy_punctuation(text: Column) -> Column:
    """As paragraphs(), and without spaces before commas and full stops."""
    return F.regexp_replace(paragraphs(text), r" +([,.])", "$1")


def comparison(text: Column) -> Column:
    """The key by which texts count as equal: cleaned, lower case, one space between words."""
    return F.regexp_replace(F.lower(paragraphs(text)), r"(?U)\s+", " ")


def slug(text: Column, joint: str = "-", default: str | None = None) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", joint)
    out = F.regexp_replace(out, f"^{joint}+|{joint}+$", "")
    return out if default is None else F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def before(text: Column, marker: str) -> Column:
    """The text up to the first marker, trimmed; all of it without one."""
    return strip(F.substring_index(text, marker, 1))


def strip_numbering(text: Column) -> Column:
    return F.regexp_replace(text, r"^\d+\.\s*", "")


def without_footnotes(text: Column) -> Column:
    return strip(F.regexp_replace(text, FOOTNOTE, " "))


def without_suffix(text: Column, suffix: str) -> Column:
    return F.regexp_replace(text, rf"(?i)\s*{suffix}\s*$", "")


def first_of(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def numbered(prefix: Column, joint: str, number: Column, width: int) -> Column:
    """An id like <prefix><joint>007."""
    return F.concat(prefix, F.lit(joint), F.lpad(number.cast("string"), width, "0"))


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def heading_path(parts: Column) -> Column:
    """Parts joined by " > ": empty ones left out, and one equal to the part before it in the comparison form."""
    kept = F.aggregate(non_empty(parts), F.array().cast("array<string>"), lambda done, x: F.when((F.size(done) > 0) & (comparison(F.element_at(done, -1)) == comparison(x)), done).otherwise(F.concat(done, F.array(x))))
    return F.nullif(F.array_join(kept, " > "), F.lit(""))


def with_page_first(path: Column, page: Column) -> Column:
    return F.when(F.size(path) == 0, F.array(page)).when(comparison(path[0]) == comparison(page), path).otherwise(F.concat(F.array(page), path))


def tokens(text: Column, stop_words) -> Column:
    """Lower-cased runs of A-Z, a-z and 0-9, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    return F.filter(found, lambda t: ~t.isin(list(stop_words)))


def table_markdown(headers: Column, rows: Column) -> Column:
    """Rows of cells as lines with " | ", under a head and a rule if there is a head."""
    line = lambda cells: F.array_join(cells, " | ")
    body = F.transform(rows, line)
    head = F.array(line(headers), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "))
    return F.array_join(F.when(F.size(headers) > 0, F.concat(head, body)).otherwise(body), "\n")


def clean_table(headers: Column, rows: Column) -> tuple[Column, Column]:
    """Cleaned cells without empty rows; without a head, the first of two or more rows becomes it."""
    cells = F.filter(F.transform(rows, lambda r: F.transform(r, paragraphs)), lambda r: F.exists(r, lambda c: c != ""))
    head = F.transform(headers, paragraphs)
    head = F.when(F.exists(head, lambda c: c != ""), head).otherwise(F.array().cast("array<string>"))
    promote = (F.size(head) == 0) & (F.size(cells) >= 2)
    return F.when(promote, cells[0]).otherwise(head), F.when(promote, F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)


def records_text(rows: Column) -> Column:
    """A table whose first row is its head: for each other row, header: cell lines; rows apart by an empty line.

    A cell under an empty header is named Column n, one beyond the head has no name.
    """
    trimmed = F.transform(rows, lambda r: F.transform(r, strip))
    head = trimmed[0]

    def line(cell: Column, i: Column) -> Column:
        name = first_of(F.get(head, i), F.concat(F.lit("Column "), (i + 1).cast("string")))
        return F.when(cell == "", None).when(i < F.size(head), F.concat(name, F.lit(": "), cell)).otherwise(cell)

    texts = F.transform(F.slice(trimmed, 2, F.greatest(F.size(trimmed) - 1, F.lit(0))), lambda r: F.array_join(F.array_compact(F.transform(r, line)), "\n"))
    return F.when(F.size(rows) > 0, F.array_join(non_empty(texts), "\n\n")).otherwise("")


def reference_block(links: Column) -> Column:
    """A block of links (structs of text and url), or null."""
    lines = F.transform(links, lambda x: F.concat(F.lit("- "), first_of(x["text"], F.lit("Source link")), F.lit(": "), x["url"]))
    return F.when(F.size(links) > 0, F.concat(F.lit("References:\n"), F.array_join(lines, "\n")))


def distinct_links(links: Column) -> Column:
    """Links with a url, the first of each (text, url)."""
    return F.array_distinct(F.filter(links, lambda x: F.coalesce(x["url"], F.lit("")) != ""))


def clock(hours: Column) -> Column:
    """Hours as 3h 05m; 59.9 minutes round up to the next hour."""
    minutes = F.round(hours * 60).cast("long")
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit("m"))


def terminal(value: Column) -> Column:
    up = F.upper(collapse(value))
    return F.when(up.startswith("T"), up).otherwise(F.concat(F.lit("T"), up))
