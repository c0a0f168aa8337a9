"""A small document tree on the standard library's parser, with the few selectors the extractors need, and text rendering."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset("script style noscript template sly".split())
BLOCKS = frozenset("p div ul ol section article table tr h1 h2 h3 h4 h5 h6".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []

    def get(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def walk(self) -> Iterator[Node]:
        """The elements inside, in page order."""
        todo = self.elements()[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.elements()[::-1]

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def all(self, *selectors: str) -> list[Node]:
        """Elements inside that fit a selector: tag, .class, tag.class, #id, or several apart by spaces, each inside the one before."""
        return [n for n in self.walk() if any(_fits(n, s.split(), self) for s in selectors)]

    def first(self, *selectors: str) -> Node | None:
        return next((n for n in self.walk() if any(_fits(n, s.split(), self) for s in selectors)), None)

    def inside(self, *selectors: str) -> bool:
        at = self.parent
        while at is not None:
            if any(_one(at, s) for s in selectors):
                return True
            at = at.parent
        return False

    def drop(self, *selectors: str) -> Node:
        for n in self.all(*selectors):
            if n.parent and n in n.parent.kids:
                n.parent.kids.remove(n)
        return self

    def raw(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = self.kids[::-1]
        while todo:
            kid = todo.pop()
            if isinstance(kid, str):
                out.append(kid)
            elif kid.tag not in UNREAD:
                todo += [" ", *kid.kids[::-1], " "]
        return "".join(out)

    def words(self) -> str:
        """All text on one line."""
        return line(self.raw())


def _one(node: Node, selector: str) -> bool:
    found = re.fullmatch(r"([a-z0-9]*)((?:[.#][\w-]+)*)", selector)
    if not found or (found[1] and node.tag != found[1]):
        return False
    return all(part[1:] in node.classes if part[0] == "." else node.get("id") == part[1:] for part in re.findall(r"[.#][\w-]+", found[2]))


def _fits(node: Node, chain: list[str], top: Node) -> bool:
    if not _one(node, chain[-1]):
        return False
    at, left = node.parent, chain[:-1]
    while left and at is not None:
        if _one(at, left[-1]):
            left = left[:-1]
        at = at.parent
    return not left


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag == "li":
            closes = ("li",) if tag == "li" else ("p",)
            up = self.at
            while up.parent is not None and up.tag not in BLOCKS | {"li", "td", "th", "body"}:
                up = up.parent
            if up.tag in closes and up.parent is not None:
                self.at = up.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_ZERO = re.compile("[\u200b\u200c\u200d\ufeff]")


def line(text: str | None) -> str:
    return " ".join(_ZERO.sub("", (text or "").replace("\u00a0", " ")).split())


def lines(text: str | None) -> str:
    text = _ZERO.sub("", (text or "").replace("\u00a0", " "))
    text = re.sub(r" *\n *", "\n", re.sub(r"[ \t\r\f]+", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def render(node: Node | None, base: str, skip: Callable[[Node], bool] = lambda n: False) -> str:
    """Text with links as markdown, list items behind dashes and blocks on lines of their own."""

    if node is None:
        return ""
    # an open element has its tag, address, and the text so far; what is closed goes into the one around it
    open_nodes: list[tuple[Node, list[str], int]] = [(node, [], 0)]
    while True:
        at, out, n = open_nodes.pop()
        if n < len(at.kids):
            open_nodes.append((at, out, n + 1))
            kid = at.kids[n]
            if isinstance(kid, str):
                out.append(re.sub(r"\s+", " ", kid))
            elif kid.tag == "br":
                out.append("\n")
            elif kid.tag not in UNREAD and not skip(kid):
                open_nodes.append((kid, [], 0))
            continue
        text = "".join(out)
        if not open_nodes:
            return lines(text)
        if at.tag == "a":
            text, target = line(text), at.get("href")
            text = f"[{text}]({urljoin(base, target)})" if text and target and not target.startswith(("#", "javascript:")) else text
        elif at.tag == "li":
            text = "\n- " + text.strip()
        elif at.tag in BLOCKS:
            text = "\n" + text + "\n"
        open_nodes[-1][1].append(text)
