"""Addresses: canonical form, page ids, allow-lists and resolving, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no parameters, query, fragment or slash at the end; other text as it is."""
    clean = F.regexp_replace(F.regexp_replace(path(url), ";[^/]*$", ""), "/+$", "")
    return F.when(scheme(url) == "", url).otherwise(F.concat(scheme(url), F.lit("://"), host(url), clean))


def page_id(url: Column) -> Column:
    """The slug of the last part of the path, without escapes and extension .html; index for none."""
    last = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    bare = F.regexp_replace(F.coalesce(F.try_url_decode(last), last), r"\.html?$", "")
    return slug(bare, "-", "index")


def allowed(url: Column, seed: Column, hosts: list[str], contains: list[str]) -> Column:
    """Whether a crawler may follow: not the seed itself, http(s), a known host, no PDF, a wanted path."""
    wanted = F.lit(False)
    for part in contains:
        wanted = wanted | F.contains(F.lower(path(url)), F.lit(part))
    return (canonical(url) != canonical(seed)) & scheme(url).isin("http", "https") & host(url).isin(hosts) & ~F.lower(path(url)).endswith(".pdf") & wanted


def resolve(link: Column, base: Column) -> Column:
    """A link against the page it's on: whole ones stay, //host, /path, ?query, #fragment and relative ones resolve; dots are folded by the caller's parser if it needs to."""
    root = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | link.startswith("?") | (link == ""), F.concat(root, path(base), link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def resource(value: Column, base: str) -> Column:
    """A link for people: trimmed, trailing marks cut, http(s) or resolved on base when it begins with a slash, else null."""
    text = F.regexp_replace(F.trim(value), "[.,;]+$", "")
    return F.when(text.rlike("^https?://"), text).when(text.startswith("/"), F.concat(F.lit(base), text))
