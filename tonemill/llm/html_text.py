"""HTML extraction by tree scoring.

A page becomes a tree; subtrees that can't be main text (scripts, menus,
footers, forms, elements named as adverts, comments, notices ...) are cut off
while it is built. Each paragraph then gives points for its length and commas
to its ancestors, in full to its parent and less further up; a container's
points are discounted by the share of its text inside links. Scores only say
where the main text lies: the least element around the best container, those
beside it and all others that score enough is widened to the outermost article
or main around it, and the text of all its blocks is returned in page order,
headings and short blocks included. Left out of it are the subtrees cut before,
and blocks of links that don't hold or belong to a container that scores enough.

A class or id that also names content doesn't cut an element: of a compound
name the last telling part counts (post-footer is a footer, sidebar-content
isn't cut), what follows no-, has-, with- or without- says nothing, and a name
of content alone (entry-content) outweighs all others. Names that layouts also
give to wrappers (widget, hidden, share, ...) cut an element only if it holds
no more than half of the page's text outside links.

Inside an article or main, names say less: what an author calls cookie-recipe or
hero-banner is content. There a name counts only if all its parts are names of
furniture, content or layout; it cuts containers, and paragraphs only as an advert
or a notice; and menus, tags, links to share and the like go only if their text
is links for the most part. An article named as a comment is cut in another.

A page is read by one scan whose steps never go back, so time grows with its
length, whatever is left unclosed. Pages are parsed in Arrow batches with no
state between them.

Defined cases: null html counts as empty and gives an empty text; a page
without paragraphs gives the text left after the cuts; unclosed, misnested and
cut-off tags and references are read as browsers do, as far as text goes, but a
quote that nothing closes ends with its tag, and an unclosed template, noscript
or foreign element hides nothing; a tag that the page's end cuts off is dropped;
an empty table gives an empty result; very long pages are read whole; repeated
rows each stay; other columns are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element groups, and the names that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title svg iframe object"
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CUT_TAGS = frozenset("head script style noscript template textarea title svg annotation annotation-xml iframe object nav header footer aside form button select dialog menu canvas audio video".split())
CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer disqus footer footnav gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion replies respond shoutbox sidebar skyscraper sponsor subscribe subscription toolbar topbar".split()
)
#: These cut an element unless it holds most of the page.
SOFT_NAMES = frozenset("foot follow header hidden login meta popular promoted recommended related reply rss share sharing signup skip social sponsored tags trending widget".split())
CUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
GOOD_NAMES = frozenset("article blog body content entry hentry main page post story text".split())
MODIFIERS = frozenset("no not non has have with without hide show".split())
#: Inside an article these count as adverts and notices on any element, and
#: those of LINK_NAMES only on lists of links.
PLAIN_NAMES = frozenset("ad ads advert adverts advertisement adsense consent cookies gdpr notice notices notification popup promo promotion sponsor".split())
LINK_NAMES = frozenset("breadcrumb breadcrumbs footnav menu nav navbar navigation pager pagination toolbar topbar byline masthead".split())
#: Parts of names that tell a place or a form, no subject.
LAYOUT_NAMES = frozenset("area bar block bottom box container form inner left list outer posts right section site slot text top unit wrap wrapper x".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead pre blockquote figure figcaption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
#: An open element of the key ends where one of its tags begins.
_ENDS = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Elements whose text is no markup, and those that only a closing tag makes so.
_RAW = frozenset("script style textarea title iframe".split())
_CLOSED = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW.split()}
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"[\s/]*+([^\s/>=]*+)")
_VALUE = re.compile(r"\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+)")
_BARE = re.compile(r"\s*+=\s*+([^\s>]*+)")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "good", "soft", "inside", "score", "size", "linked", "links", "commas")

    def __init__(self, tag: str, parent: Node | None, good: bool = False, soft: bool = False):
        self.tag, self.parent, self.good, self.soft = tag, parent, good, soft
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.children: list[Node | str] = []
        self.score, self.size, self.linked, self.links, self.commas = 0.0, 0, 0, 0, 0


def _names(tag: str, attrs: list[tuple[str, str]], inside: bool = False) -> tuple[str, bool]:
    """(how an element is furniture: "", "soft" or "cut"; is named like content)."""
    bad, good = "", False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDING.search(value)):
            return "cut", False
        if name == "role" and value.lower() in CUT_ROLES:
            return "cut", False
        if name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _PART.findall(word)]
                told = next((i for i, p in enumerate(parts) if p in MODIFIERS), len(parts))
                known = [p for p in parts[:told] if p in CUT_NAMES or p in SOFT_NAMES or p in GOOD_NAMES]
                means = _meaning(known)
                if inside and means in ("soft", "cut"):
                    means = _meaning_inside(tag, parts[:told], known[-1], means)
                if means == "good":
                    good = True
                elif means == "cut" or not bad:
                    bad = means
    return "" if good else bad, good


def _meaning(known: list[str]) -> str:
    """What the telling parts of a name say: "", "good", "soft" or "cut"."""
    if not known:
        return ""
    if known[-1] in CUT_NAMES:
        return "cut"
    if known[-1] in SOFT_NAMES:
        return "soft"
    return "" if (CUT_NAMES | SOFT_NAMES).intersection(known) else "good"


def _meaning_inside(tag: str, parts: list[str], last: str, means: str) -> str:
    """The same for a name of furniture inside an article or main."""
    if not all(p in CUT_NAMES or p in SOFT_NAMES or p in GOOD_NAMES or p in LAYOUT_NAMES for p in parts):
        return ""
    if last in PLAIN_NAMES:
        return "cut"
    if tag in TEXT_TAGS or tag not in BLOCK:
        return ""
    if last in ("widget", "signup"):
        return "cut"
    return "soft" if last in LINK_NAMES else means


def tokens(text: str) -> Iterator[tuple[str, str, list[tuple[str, str]], bool]]:
    """("text", its text), ("open" or "close", tag, attributes, whether it closes
    itself): what a page is made of, without comments and raw elements."""
    at, start, n = 0, 0, len(text)
    last = {q: text.rfind(q) for q in "\"'"}
    never: set[str] = set()  # elements that nothing closes from here on
    while (at := text.find("<", at)) >= 0:
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield "text", text[start:at], [], False
        elif text.startswith(("<!", "<?"), at):
            end = text.find(">", at)
            end = n if end < 0 else end + 1
            yield "text", text[start:at], [], False
        elif m := _TAG.match(text, at):
            yield "text", text[start:at], [], False
            tag, end, attrs, shut = m[1].lower(), m.end(), [], False
            while end < n and text[end] != ">":
                a = _ATTR.match(text, end)
                end, name, value = a.end(), a[1].lower(), ""
                shut = not name and text[end - 1] == "/"
                if v := _BARE.match(text, end):
                    quote = v[1][:1]
                    if quote in last and quote and last[quote] > v.start(1):
                        v = _VALUE.match(text, end)
                    end, value = v.end(), v[1].strip("\"'") if v[1][:1] in last else v[1]
                if name:
                    attrs.append((name, value))
            end, whole = end + 1, end < n
            if not whole:
                return  # cut off by the end of the page
            if text[at + 1] == "/":
                yield "close", tag, [], False
            elif tag in _CLOSED:
                close = _CLOSED[tag].search(text, end) if not shut and tag not in never else None
                if close:
                    end = text.find(">", close.end() - 1)
                    end = n if end < 0 else end + 1
                elif tag in _RAW:
                    return
                else:
                    never.add(tag)
            else:
                yield "open", tag, attrs, shut
        else:
            at += 1
            continue
        at = start = end
    yield "text", text[start:], [], False


def parse(text: str) -> Node:
    """The tree of a page without the subtrees that are cut."""
    root = Node("#root", None)
    at = root
    cut: list[str] = []  # open elements from the one that was cut

    def add(s: str) -> None:
        if s and not cut:
            at.children.append(s)

    for kind, tag, attrs, shut in tokens(text):
        if kind == "text":
            add(tag)
            continue
        if kind == "close":
            if cut:
                if tag in cut:
                    del cut[len(cut) - 1 - cut[::-1].index(tag) :]
                elif tag in ("article", "main", "body", "html"):
                    cut.clear()  # the cut element was never closed
            if not cut and tag not in VOID:
                seek = at
                while seek is not root and seek.tag != tag:
                    if seek.tag in BLOCK and tag not in BLOCK:  # an inline end doesn't close blocks
                        seek = root
                        break
                    seek = seek.parent
                if seek is not root:
                    at = seek.parent
            continue
        if cut:
            if tag in ("article", "main") and cut[0] not in ("aside", "nav", "footer", "section", "ol", "ul", "article") and "div" not in cut:
                cut.clear()
            else:
                if tag not in VOID and not shut:
                    while cut[-1] in _ENDS and tag in _ENDS[cut[-1]] and len(cut) > 1:
                        cut.pop()
                    cut.append(tag)
                continue
        while at.tag in _ENDS and tag in _ENDS[at.tag]:
            at = at.parent
        if tag in BLOCK:  # a block ends a paragraph around it, inline elements and all
            seek = at
            while seek is not root and seek.tag not in BLOCK:
                seek = seek.parent
            if seek.tag == "p":
                at = seek.parent
        if tag in VOID:
            at.children.append(Node(tag, at))
            continue
        bad, good = _names(tag, attrs, at.inside)
        whole = ("html", "body", "main") if at.inside else ("html", "body", "article", "main")
        if tag in CUT_TAGS or (bad == "cut" and tag not in whole):
            if not shut:
                cut.append(tag)
            continue
        node = Node(tag, at, good or tag in ("article", "main"), bad == "soft" and tag not in ("html", "body", "article", "main"))
        at.children.append(node)
        at = node
    return root


def prune(root: Node) -> None:
    """Leave out elements of a soft name: inside an article or main lists of
    links, elsewhere what doesn't hold most of the page."""
    _measure(root, False)
    most, stack = 0.5 * (root.size - root.linked), [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not c.soft or (not c.linked or c.size > 2 * c.linked + 25 if n.inside else c.size - c.linked > most)]
        stack.extend(c for c in n.children if isinstance(c, Node))


def _measure(node: Node, in_link: bool) -> None:
    """Text sizes of node and below; iterative, as pages may nest deeply."""
    order, stack = [], [(node, in_link)]
    while stack:
        n, link = stack.pop()
        link = link or n.tag == "a"
        order.append(n)
        n.size, n.linked, n.links, n.commas = 0, 0, 0, 0
        for c in n.children:
            if isinstance(c, str):
                size = len(c.strip())
                n.size += size
                n.linked += size * link
                n.commas += c.count(",") + c.count("，") + c.count("、")
            else:
                stack.append((c, link))
    for n in reversed(order):
        n.links += n.tag == "a"
        if n.parent is not None and n is not node:
            n.parent.links += n.links
            n.parent.size += n.size
            n.parent.linked += n.linked
            n.parent.commas += n.commas


def _is_paragraph(node: Node) -> bool:
    if node.tag in PARAGRAPHS:
        return True
    return node.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and len(c.strip()) > 25 for c in node.children)


def _above(node: Node) -> list[Node]:
    """node and the elements around it, the innermost first."""
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _is_link_list(node: Node) -> bool:
    return node.tag in BLOCK and node.tag not in HEADINGS and node.links >= 3 and node.linked > 0.75 * node.size


def worths(root: Node) -> list[tuple[Node, float]]:
    """Containers with points, each with its points less the share of links."""
    _measure(root, False)
    scored: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        stack.extend(c for c in n.children if isinstance(c, Node))
        if n.size and _is_paragraph(n):
            points = 1.0 + n.commas + min(n.size / 100, 3.0)
            up, share = n.parent if n.tag in PARAGRAPHS else n, 1.0
            for level in range(1, 6):
                if up is None or up.tag == "#root":
                    break
                if not up.score:
                    scored.append(up)
                    up.score = 25.0 if up.good else 5.0 if up.tag in ("div", "section") else 0.01
                up.score += points * share
                up, share = up.parent, 1 / (2 * level)
    return [(n, n.score * (1 - n.linked / max(n.size, 1))) for n in scored]


def best_containers(root: Node) -> list[Node | str]:
    """What holds the main text: the nodes of one region, in page order."""
    prune(root)
    found = worths(root)
    if not found:
        return [root]
    scored, worth = [n for n, _ in found], {id(n): w for n, w in found}
    best = max(scored, key=lambda n: worth[id(n)])
    top = worth[id(best)]
    bar = max(0.2 * top, min(10.0, 0.5 * top))
    around = _above(best)
    depth = {id(n): i for i, n in enumerate(around)}
    enough = [best] + [n for n in scored if worth[id(n)] >= bar and id(n) not in depth]
    whole, holds = {id(n) for n in enough}, set()
    level = min(1, len(around) - 1)
    for n in enough:
        while n is not None and id(n) not in holds:
            holds.add(id(n))
            if id(n) in depth:
                level = max(level, depth[id(n)])
                break
            n = n.parent
    holds.update(depth)
    level = max([level] + [i for i, n in enumerate(around) if n.tag in ("article", "main")])
    # Subtrees of links go, unless they are or hold what scored enough.
    stack = [around[level]]
    while stack:
        n = stack.pop()
        if id(n) in whole:
            continue
        n.children = [c for c in n.children if isinstance(c, str) or id(c) in holds or not _is_link_list(c)]
        stack.extend(c for c in n.children if isinstance(c, Node))
    return [around[level]]


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below nodes, in page order, references decoded and
    white space closed up."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            line = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if line:
                out.append(line)

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            run.append(n)
        elif n.tag == "br":
            run.append("\n")
        elif n.tag in BLOCK:
            close()
            stack.append(None)
            stack.extend(reversed(n.children))
        else:
            stack.extend(reversed(n.children))
    close()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(best_containers(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    # Nullable integers as strings, lest pandas make floats of them.
    narrow = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    out = narrow.mapInPandas(run, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast(kinds["page_id"]).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
