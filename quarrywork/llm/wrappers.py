"""HTML extraction by wrapper inference: the pages of a host give a union-free regular expression, and that tells the article.

A page is read as a tree of blocks (paragraphs, lists, sections); what stands
between their tags is text, with inline markup taken off. The tokens of a page
are its blocks, labelled by tag, class and id, and its texts. A wrapper is a
union-free regular expression over them, nested like the tree: a sequence of
blocks and texts, each once, optional (?) or repeated (+, or * for both), and
repeated groups of several. It starts as one page's own tree, where neighbours
alike fold into a repeated item and neighbouring sequences alike into a
repeated group. Aligning it with another page resolves each mismatch: what only
one side has becomes optional, what one side repeats becomes repeated, and
texts that differ make a slot. Iterating this over all pages of a host gives
its wrapper.

Each text item counts, by hashes, on how many pages a text stands there. Texts
that nearly all pages (CONSTANT of them, and TOGETHER pages at least) have in
the same place are the template's, not the article's, unless most pages have
one and the same longest text, as then they are copies of each other. Other
text fills slots. The counts are kept for the KEPT most frequent texts of an
item when wrappers are aligned, so a template's texts stay in.

The article is chosen by its slots: from the root down, the block whose slots
hold nearly all text outside of links, until text spreads over several blocks
or repeats. What a slot holds is an average over the host's pages, and the
choice is among the items that a page has, so pages of several templates on one
host are each cut by their own branch. Headings passed on the way down belong
to the article. Only where slots can't decide, as text is spread over unlike
blocks, the names of elements do (article, main, or a class like content).
Within the article, template texts and lists of links are left out, and blocks
that are no article text by their tag or name: navigation, page headers and
footers, asides, forms, notices, adverts, comments.

Bounds: a wrapper keeps ITEMS items; rarer ones go, and blocks without an item
are judged by the page's own text. Long sequences, where a longest common
subsequence would take over CELLS steps, are aligned greedily. Both concern the
choice of the article, no text is cut off. Trees are walked without recursion,
so depth has no limit.

Pages with one and the same folded tree count once, with sums, before anything
is shuffled. Wrappers of a host merge in rounds of FAN, as many as the host with
most of them needs, so that a host that has a third of all pages is spread. The wrappers, one
for a host, are sent to all where they are SENT bytes together at the most, and
else join the pages by host.

Defined results: null or empty html, or html without an article's text, gives
an empty text; a null URL, or one without a host, belongs to the host "";
malformed html is read as browsers would, but that an attribute's quotation
mark without an end doesn't swallow what follows; repeated rows are cut one by
one; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, saved, slices, small_batches

CONSTANT, TOGETHER, KEPT, ITEMS, CELLS = 0.9, 10, 256, 5000, 1_000_000
SENT = 32 << 20
#: Wrappers of a host that one task merges, about.
FAN = 64

#: Fixed lists. Elements without content; whose content is no markup; that end an open paragraph and separate blocks;
#: that end an open element of their own kind; whose text is not looked into further.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select object audio video canvas xmp".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SIBLING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre dd dt figure ul ol dl table".split())
#: Tags of what isn't the article's text, and words of its names; words that may stand beside these in a name.
CHROME_TAGS = frozenset("head nav footer aside form button dialog menu".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar toolbar"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus replies reply discussion share sharing social"
    " related recommended recommendations widget search pagination pager skip copyright legal".split()
)
BESIDE = frozenset(
    "left right top bottom main site page box block wrap wrapper container list area section item bar link links content inner outer primary secondary global unit slot post posts article articles text button buttons thread"
    " form body id icons row col column panel zone region holder media google sticky fixed mobile desktop first last small large new icon policy message messages".split()
)
MAIN_WORDS = frozenset("content main article post entry story body text maincontent articlebody".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=)*+)(?:>|\Z)|([^<]+|<)", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

ONCE, OPTIONAL, SOME, ANY = "1", "?", "+", "*"
TEXT = "#"


def is_chrome(tag: str, names: Iterable[str]) -> bool:
    """Whether a tag, or one of the names in class, id and role, says that this isn't an article's text."""
    if tag in CHROME_TAGS:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for name in names:
        if _speaks_of(name, CHROME_WORDS):
            return True
    return False


def _speaks_of(name: str, words: frozenset[str]) -> bool:
    """Whether a name has one of the words, and beside it nothing that could mean something else."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return not words.isdisjoint(parts) and all(p in words or p in BESIDE or p.isdigit() for p in parts)


class Text:
    """Text between the tags of blocks: white space in one, characters in links; item is its place in the wrapper."""

    __slots__ = ("text", "links", "item")

    def __init__(self, text: str, links: int):
        self.text, self.links, self.item = text, links, None

    def key(self) -> int:
        return xxhash.xxh32_intdigest(self.text)


class Block:
    """tag, label (tag and names), and what it holds in order: texts and blocks."""

    __slots__ = ("tag", "label", "names", "chrome", "held", "item", "chars", "links")

    def __init__(self, tag: str, label: str = "", names: tuple[str, ...] = (), chrome: bool = False):
        self.tag, self.label, self.names, self.chrome = tag, label, names, chrome
        self.held: list[Text | Block] = []
        self.item, self.chars, self.links = None, 0, 0


def _named(tag: str, attributes: str) -> tuple[str, tuple[str, ...]]:
    """The label of a tag, and its names."""
    if "=" not in attributes:
        return tag, ()
    found = [(k.lower(), (a or b or c).strip()) for k, a, b, c in _NAMES.findall(attributes)]
    label = " ".join([tag, *(f"{k}={re.sub('[0-9]+', '0', v.lower())}" for k, v in found)])
    return label, tuple(name for _, v in found for name in v.split())


def parse(page: str | None) -> Block:
    """The blocks of a page, however malformed."""
    page = page or ""
    root = Block("")
    stack: list[tuple[str, Block, bool, bool]] = [("", root, False, False)]  # tag, the block it is in or is, in a link, left out
    count: Counter[str] = Counter()
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                stack[-1][1].held.append(Text(text, min(linked, len(text))))
            run.clear()
            linked = 0

    def close(depth: int) -> None:
        if any(entry[0] in BLOCK for entry in stack[depth:]):
            flush()
        for entry in stack[depth:]:
            count[entry[0]] -= 1
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.match(page, at)
        at = token.end()
        closing, name, attributes, text = token.groups()
        if text is not None:
            if not stack[-1][3]:
                text = entities.unescape(text) if "&" in text else text
                run.append(text)
                linked += len(text) if stack[-1][2] else 0
            continue
        if name is None:
            continue
        tag = name.lower()
        block = tag in BLOCK
        if closing:
            if count[tag] > 0:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                    if not block and stack[depth][0] in BLOCK:
                        break  # an inline element doesn't end a block
            elif tag in ("p", "br"):
                flush()  # stands for an empty paragraph, or a line's end
            continue
        shut = attributes.rstrip().endswith("/")
        if tag in RAW:
            if not shut:
                found = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = found.end() if found else end
            continue
        if block and count["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):  # ends an open paragraph, and what inline elements were left open in it
                if stack[depth][0] == "p":
                    if tag != "br":
                        close(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if tag in SIBLING and any(count[t] > 0 for t in (tag, "dt", "dd", "td", "th")):
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in same:
                    close(depth)
                    break
                if stack[depth][0] in SIBLING[tag]:
                    break
        if block:
            flush()
        _, inside, link, out = stack[-1]
        if tag in VOID:
            continue
        label, names = _named(tag, attributes)
        chrome = is_chrome(tag, names)
        if tag == "header":
            chrome = not (count["article"] or count["main"] or count["section"])
        if block:
            own = Block(tag, label, names, chrome or out)
            inside.held.append(own)
            out = False  # its label says so
        else:
            own, out = inside, out or chrome
        if not shut or block:
            count[tag] += 1
            stack.append((tag, own, link or tag == "a", out))
    flush()
    for own in reversed(_all(root)):
        for held in own.held:
            if isinstance(held, Text):
                own.chars, own.links = own.chars + len(held.text), own.links + held.links
            else:
                own.chars, own.links = own.chars + held.chars, own.links + held.links
        if own.tag in ("div", "section") and not any(isinstance(h, Block) for h in own.held):
            own.label += " " + TEXT  # such tags say little: one of text only isn't like one that holds blocks
    return root


def _all(root: Block) -> list[Block]:
    """A block and all in it, each before what it holds."""
    out, todo = [], [root]
    while todo:
        block = todo.pop()
        out.append(block)
        todo += [h for h in reversed(block.held) if isinstance(h, Block)]
    return out


# ---- wrappers


class Item:
    """l: label; q: quantifier; k: items inside; g: labels of a group's members if it is one; n: pages that have it.

    Of a text: c: its characters, a: those in links, t: of each text, by a hash, on how many pages it is and its length.
    The root's t is of the longest text of each page.
    """

    __slots__ = ("l", "q", "k", "g", "n", "c", "a", "t", "constant", "mass", "chars", "links")

    def __init__(self, label: str, q: str, k: list[Item], g: tuple[str, ...], n: int, c: int = 0, a: int = 0, t: dict[int, tuple[int, int]] | None = None):
        self.l, self.q, self.k, self.g, self.n, self.c, self.a, self.t = label, q, k, g, n, c, a, t or {}

    def but(self, q: str) -> Item:
        return Item(self.l, q, self.k, self.g, self.n, self.c, self.a, self.t)


def infer(page: Block) -> Item:
    """The wrapper of one page."""
    made: dict[int, Item] = {}
    longest = Text("", 0)
    for block in reversed(_all(page)):
        kids = []
        for held in block.held:
            if isinstance(held, Text):
                kids.append(Item(TEXT, ONCE, [], (), 1, len(held.text), held.links, {held.key(): (1, len(held.text))}))
                longest = held if len(held.text) > len(longest.text) else longest
            else:
                kids.append(made.pop(id(held)))
        made[id(block)] = Item(block.label, ONCE, fold(kids), (), 1)
    own = made[id(page)]
    own.t = {longest.key(): (1, len(longest.text))}
    return own


def _quantifier(a: str, b: str, optional: bool = False, repeated: bool = False) -> str:
    optional = optional or a in (OPTIONAL, ANY) or b in (OPTIONAL, ANY)
    repeated = repeated or a in (SOME, ANY) or b in (SOME, ANY)
    return ANY if optional and repeated else OPTIONAL if optional else SOME if repeated else ONCE


def _texts(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]], same: bool) -> dict[int, tuple[int, int]]:
    """Counts of both; of one and the same page, a text counts once."""
    if len(a) < len(b):
        a, b = b, a
    out = dict(a)
    for key, (n, length) in b.items():
        had = out.get(key, (0, 0))[0]
        out[key] = (max(had, n) if same else had + n, length)
    if len(out) > KEPT and not same:
        out = dict(sorted(out.items(), key=lambda x: (-x[1][0], x[0]))[:KEPT])
    return out


def unite(a: Item, b: Item, repeated: bool = False, same: bool = False) -> Item:
    """Both in one: the same label, or groups of the same labels. same: both are of one page."""

    def pair(x: Item, y: Item, repeated: bool = False) -> Item:
        return Item(x.l, _quantifier(x.q, y.q, repeated=repeated), [], x.g, max(x.n, y.n) if same else x.n + y.n, x.c + y.c, x.a + y.a, _texts(x.t, y.t, same))

    top = pair(a, b, repeated)
    todo = [(a.k, b.k, top)]
    while todo:
        x, y, to = todo.pop()
        for p, q in align(x, y):
            if p is None or q is None:
                one = p or q
                to.k.append(one.but(_quantifier(one.q, ONCE, optional=True)))
            else:
                both = pair(p, q)
                to.k.append(both)
                todo.append((p.k, q.k, both))
    return top


def fold(items: list[Item]) -> list[Item]:
    """Neighbours alike become one repeated item, neighbouring sequences alike a repeated group."""
    out: list[Item] = []
    for item in items:
        if out and out[-1].l == item.l and not out[-1].g:
            out[-1] = unite(out[-1], item, repeated=True, same=True)
        else:
            out.append(item)
    labels = [i.l for i in out]
    if len(set(labels)) == len(labels):
        return out
    places: dict[str, list[int]] = defaultdict(list)
    for i, label in enumerate(labels):
        places[label].append(i)
    at, folded = 0, []
    while at < len(out):
        size = 0
        if not out[at].g:
            where = places[labels[at]]
            for i in where[bisect_left(where, at) + 1 :]:
                if 2 * i - at > len(out):
                    break
                if labels[at:i] == labels[i : 2 * i - at] and not any(x.g for x in out[at:i]):
                    size = i - at
                    break
        if size:
            group = _grouped(out[at : at + size])
            at += size
            while tuple(labels[at : at + size]) == group.g:
                group = unite(group, _grouped(out[at : at + size]), repeated=True, same=True)
                at += size
            folded.append(group)
        else:
            folded.append(out[at])
            at += 1
    return folded


def _grouped(items: list[Item]) -> Item:
    names = tuple(i.l for i in items)
    return Item("(" + "|".join(names) + ")", ONCE, items, names, max(i.n for i in items))


def _regroup(items: list[Item], others: list[Item]) -> list[Item]:
    """Sequences that the other side has as a group become one too."""
    for group in others:
        names = group.g
        if not names or any(i.l == group.l for i in items):
            continue
        labels = [i.l for i in items]
        for at in range(len(items) - len(names) + 1):
            if labels[at] == names[0] and tuple(labels[at : at + len(names)]) == names:
                items = [*items[:at], _grouped(items[at : at + len(names)]), *items[at + len(names) :]]
                break
    return items


def align(a: list[Item], b: list[Item]) -> list[tuple[Item | None, Item | None]]:
    """One sequence for two: what matches in pairs, what one side only has with None for the other."""
    if any(i.g for i in a) or any(i.g for i in b):
        a, b = _regroup(a, b), _regroup(b, a)
    one, two = [i.l for i in a], [i.l for i in b]
    if one == two:
        return list(zip(a, b))
    if len(a) * len(b) > CELLS:
        return _greedy(a, b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        here, below, label = best[i], best[i + 1], one[i]
        for j in range(len(b) - 1, -1, -1):
            here[j] = below[j + 1] + 1 if label == two[j] else max(below[j], here[j + 1])
    out: list[tuple[Item | None, Item | None]] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and one[i] == two[j]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out


def _greedy(a: list[Item], b: list[Item]) -> list[tuple[Item | None, Item | None]]:
    """Each of b with the next of a that has its label."""
    where: dict[str, list[int]] = defaultdict(list)
    for i, item in enumerate(a):
        where[item.l].append(i)
    out: list[tuple[Item | None, Item | None]] = []
    at = 0
    for item in b:
        places = where.get(item.l, [])
        i = bisect_left(places, at)
        if i == len(places):
            out.append((None, item))
        else:
            out += [(x, None) for x in a[at : places[i]]]
            out.append((a[places[i]], item))
            at = places[i] + 1
    return out + [(x, None) for x in a[at:]]


def preorder(root: Item) -> list[tuple[int, Item]]:
    """(depth, item), each before what it holds."""
    out, todo = [], [(0, root)]
    while todo:
        depth, item = todo.pop()
        out.append((depth, item))
        todo += [(depth + 1, k) for k in reversed(item.k)]
    return out


def expression(root: Item) -> str:
    """The wrapper as a regular expression; equal for pages of one shape."""
    out: list[str] = []
    open_items: list[tuple[int, str]] = []
    for depth, item in preorder(root):
        while open_items and open_items[-1][0] >= depth:
            out.append(open_items.pop()[1])
        q = "" if item.q == ONCE else item.q
        if item.l == TEXT:
            out.append(TEXT + q)
        else:
            out.append("(" if item.g else f"<{item.l}>")
            open_items.append((depth, (")" if item.g else "</>") + q))
    return "".join([*out, *(x for _, x in reversed(open_items))])


def dump(root: Item) -> bytes:
    rows = [(depth, i.l, i.q, i.g, i.n, i.c, i.a, [(h, n, length) for h, (n, length) in i.t.items()]) for depth, i in preorder(root)]
    return zlib.compress(json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def load(data: bytes) -> Item:
    path: list[Item] = []
    for depth, label, q, g, n, c, a, t in json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass")):
        item = Item(label, q, [], tuple(g), n, c, a, {h: (n, length) for h, n, length in t})
        del path[depth:]
        if path:
            path[-1].k.append(item)
        path.append(item)
    return path[0]


def pruned(root: Item, most: int = ITEMS) -> Item:
    """Without the rarest items, and what they hold, where there are more than so many."""
    every = preorder(root)
    if len(every) <= most:
        return root
    least = sorted((i.n for _, i in every), reverse=True)[most]
    for _, item in every:
        item.k = [k for k in item.k if k.n > least]
    return root


def prepare(root: Item) -> Item:
    """Works out, of each item, the template's texts (constant), and what its slots hold on a page on average (mass)."""
    copies = max((n for n, _ in root.t.values()), default=0) > root.n / 2
    for _, item in reversed(preorder(root)):
        item.constant, item.chars, item.links = frozenset(), item.c, item.a
        if item.l == TEXT:
            if item.n >= TOGETHER and not copies:
                item.constant = frozenset(h for h, (n, _) in item.t.items() if n >= CONSTANT * item.n)
            slots = item.c - sum(n * length for h, (n, length) in item.t.items() if h in item.constant)
            item.mass = max(0, slots - item.a) / item.n
        else:
            tag, _, names = item.l.partition(" ")
            words = [w for part in names.split(" ") for w in part.rpartition("=")[2].split()]
            total = 0.0
            for kid in item.k:
                item.chars, item.links = item.chars + kid.chars, item.links + kid.links
                total += kid.mass * kid.n
            item.mass = 0.0 if not item.g and is_chrome(tag, words) and tag != "form" else total / item.n
    return root


# ---- cutting a page


def assign(page: Block, wrapper: Item) -> None:
    """Gives each block and text its item, found in order; one may stay with its item or go on to a later one, or back within a group."""
    todo = [(page, wrapper)]
    page.item = wrapper
    while todo:
        block, item = todo.pop()
        steps = [(member, at) for at, i in enumerate(item.k) for member in (i.k if i.g else [i])]
        where: dict[str, list[int]] = defaultdict(list)
        restart: dict[tuple[str, int], int] = {}
        for i, (member, place) in enumerate(steps):
            where[member.l].append(i)
            restart.setdefault((member.l, place), i)
        at = 0
        for held in block.held:
            label = TEXT if isinstance(held, Text) else held.label
            places = where.get(label)
            if places is None:
                continue
            i = bisect_left(places, at)
            found = places[i] if i < len(places) else None
            place = steps[at][1]
            if found is None or steps[found][1] != place:
                again = restart.get((label, place))
                found = again if again is not None else found if found is not None else places[0]
            at = found
            held.item = steps[found][0]
            if isinstance(held, Block):
                todo.append((held, held.item))


def _weight(held: Text | Block) -> float:
    """Characters of slots outside of links: on the host's pages with this item, or where it has none on this page."""
    if held.item is not None:
        return held.item.mass
    return len(held.text) - held.links if isinstance(held, Text) else 0 if held.chrome else held.chars - held.links


def choose(page: Block) -> list[Block]:
    """The blocks whose text is kept; the page's blocks have their items."""
    region, heads = page, []
    while True:
        groups: dict[int, list] = {}
        for held in region.held:
            if isinstance(held, Block) and held.chrome and held.tag != "form":
                continue
            group = groups.setdefault(id(held.item) if held.item is not None else id(held), [_weight(held), held, 0])
            group[2] += 1
        total = sum(g[0] for g in groups.values())
        if not total:
            break
        weight, best, times = max(groups.values(), key=lambda g: g[0])
        if weight < 0.8 * total:
            leaves = sum(g[0] for g in groups.values() if isinstance(g[1], Text) or g[1].tag in LEAF)
            if region.tag in ("", "html", "body", "div", "form") and leaves < 0.2 * total and (named := _by_name(region, total)):
                return heads + named
            break
        if isinstance(best, Text) or best.tag in LEAF or times > 1 or (best.item is not None and best.item.q in (SOME, ANY)):
            break
        heads += [h for h in region.held if isinstance(h, Block) and h.tag in ("h1", "h2") and not h.chrome]
        region = best
    return [*heads, region]


def _by_name(region: Block, total: float) -> list[Block]:
    """Blocks in a region that are named like an article and hold a quarter of its text at least."""
    found: tuple[list[Block], ...] = ([], [], [])
    todo = [h for h in region.held if isinstance(h, Block)]
    while todo:
        block = todo.pop()
        if block.chrome and block.tag != "form":
            continue
        kind = 0 if block.tag == "article" else 1 if block.tag == "main" or "role=main" in block.label else 2 if block.tag in ("div", "section", "td") and any(_speaks_of(n, MAIN_WORDS) for n in block.names) else None
        if kind is not None and 4 * _weight(block) >= total:
            found[kind].append(block)
        todo += [h for h in block.held if isinstance(h, Block)]
    for kind in found:
        if kind:
            return kind
    return []


def cut(page: Block, wrapper: Item) -> str:
    """The text of the kept slots: blocks in page order, joined by newlines. wrapper is prepared."""
    assign(page, wrapper)
    regions = {id(b) for b in choose(page)}
    out: list[str] = []
    todo: list[tuple[Text | Block, bool]] = [(page, False)]
    while todo:
        held, inside = todo.pop()
        if isinstance(held, Text):
            if inside and not (held.item is not None and held.item.constant and held.key() in held.item.constant):
                out.append(held.text)
            continue
        if id(held) in regions:
            inside = True
        elif inside:
            own = held.item if held.item is not None else held
            menu = held.tag in ("ul", "ol", "div", "section", "table") and own.chars and 10 * own.links > 8 * own.chars
            if held.chrome or menu:
                continue
        todo += [(h, inside) for h in reversed(held.held)]
    return "\n".join(out)


# ---- on Spark


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1), F.lit("")))


_WRAPPERS = "host string, wrapper binary"


def wrappers(pages: DataFrame, fan: int = FAN, most: int = 2000, held_items: int = 100_000, scope: str = "session") -> DataFrame:
    """(host, wrapper): the wrapper of each host, as bytes for load().

    A task unites pages of one shape as it reads them, and lets go of what it
    has at most shapes or held_items items. A host's rows then unite in lots of
    about fan, and what comes of these again, until no host has more.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], Item] = {}
        items = 0

        def out() -> pa.RecordBatch:
            rows = [(host, dump(w)) for (host, _), w in seen.items()]
            seen.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["host", "wrapper"])

        for batch in batches:
            for part in slices(batch, 1):
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = infer(parse(page))
                    shape = expression(own)
                    key = (host, xxhash.xxh64_intdigest(shape))
                    if key in seen:
                        seen[key] = unite(seen[key], own)
                    else:
                        seen[key] = own
                        items += shape.count("<") + shape.count(TEXT)
                    if len(seen) >= most or items > held_items:
                        yield out()
                        items = 0
        if seen:
            yield out()

    def merged(group):
        import pandas as pd

        whole = None
        for data in sorted(group["wrapper"]):
            whole = load(data) if whole is None else pruned(unite(whole, load(data)), 4 * ITEMS)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [dump(pruned(whole))]})

    found = saved(pages.select("host", "html").mapInArrow(shapes, _WRAPPERS), scope)
    # dealt out explicitly: few bytes may be much work, and would be put into one task
    tasks = partitions_for(pages.sparkSession)
    while (rows := found.groupBy("host").count().agg(F.max("count")).head()[0] or 0) > fan:
        lot = F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.lit(-(-rows // fan)))
        found = saved(found.withColumn("lot", lot).repartition(tasks, "host", "lot").groupBy("host", "lot").applyInPandas(merged, _WRAPPERS), scope)
    return found.repartition(tasks, "host").groupBy("host").applyInPandas(merged, _WRAPPERS)


def extract(pages: DataFrame, scope: str = "session", most_sent: int = SENT) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    small_batches(pages.sparkSession)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    known = saved(wrappers(keyed, scope=scope), scope)
    size = known.agg(F.sum(F.length("wrapper") + F.length("host"))).head()[0] or 0
    sent = None
    if size <= most_sent:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["wrapper"]) for r in known.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[bytes, Item] = {}
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for page, key in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    data = key if sent is None else sent.value[key]
                    if data not in read:
                        if len(read) > 200:
                            read.clear()
                        read[data] = prepare(load(data))
                    out.append(cut(parse(page), read[data]))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = keyed.select("page_id", "url", "html", "host") if sent else keyed.join(known, "host").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
