"""URL filters: a trie over reversed host labels, then path segments; the longest fitting entry decides.

A rule is (host, path, verdict). It fits a URL when the URL's host is the
rule's host or a subdomain of it and the URL's path starts with the rule's
path. Among the rules that fit, more host labels win, then the longer path,
then block over allow. The rules are a parameter of the job, not data: their
number is checked, and the trie is broadcast, so an executor gets it once.

Defined results: a null URL, or one without "://", has an empty host and path,
fits no rule and gets the default verdict. Repeated rows keep a result each; an
empty table gives an empty table; very long URLs are judged whole.
Other columns of the input are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

MAX_RULES = 2_000_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


class UrlTrie:
    """Nodes are dicts: host labels from the last one to the first; under None, the paths of the rules that end there."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules are too many to send to every executor; the bound is {MAX_RULES}")
        self.root: dict = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *segments, rest = path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})  # by length, what may follow the last slash, down to the empty string
            ends = ends.setdefault(len(rest), {})
            if ends.get(rest, ("", "allow"))[1] != "block":
                ends[rest] = (host + path, verdict)

    @staticmethod
    def _along_path(node: dict, path: str) -> tuple[str, str] | None:
        """The rule with the longest path that the path starts with."""
        best, at = None, 0
        while True:
            for size, ends in sorted(node.get(None, {}).items(), reverse=True):
                if (found := ends.get(path[at : at + size])) is not None:
                    best = found
                    break
            cut = path.find("/", at)
            if cut < 0 or (child := node.get(path[at:cut])) is None:
                return best
            node, at = child, cut + 1

    def lookup(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match, or None."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node and (found := self._along_path(node[None], path)):
                best = found
        return best


_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there to "?", "#" or the end."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest.translate(_UPPER), "") if slash < 0 else (rest[:slash].translate(_UPPER), rest[slash:])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: its host, its path, the rule that decides and the verdict. Reads two columns, shuffles nothing."""
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths, found, verdicts = [], [], [], []
        for url in batch.column(1).to_pylist():
            host, path = host_and_path(url)
            rule, verdict = trie.value.lookup(host, path) or (None, default)
            hosts.append(host)
            paths.append(path)
            found.append(rule)
            verdicts.append(verdict)
        text = pa.string()
        return pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(hosts, text), pa.array(paths, text), pa.array(found, text), pa.array(verdicts, text)], ["page_id", "host", "path", "rule", "verdict"])

    return map_batches(pages.select(id_col, url_col), judge, SCHEMA)
